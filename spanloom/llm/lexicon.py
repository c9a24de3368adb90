"""Words of the abuse grammar by category, in English, German, Spanish and French, and the forms they take.

Words are given as lemmas without accents; their forms come from rules of inflection and compounding.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Words that do not inflect, by symbol.
FIXED = {
    "Y": "t you your yours yourself yourselves u ur ya du dir dich dein deine deinen deinem deiner euch euer eure eurem euren ihr tu te ti tus usted ustedes vosotros vos os toi ton ta tes vous votre",
    "YSUBJ": "you u ya t du ihr tu usted ustedes vosotros vos toi vous",
    "I": "i we ich wir yo nosotros je j nous",
    "ME": "me us mir mich uns mi nosotros moi nous",
    "THEY": "they them sie ihnen los las les ellos ellas ils elles eux leur",
    "HIS": "his her their seine seinen seinem seiner ihre ihren ihrem ihrer su sus son sa ses leur leurs",
    "ONE": "he she him her er sie ihn ihm el ella le lo la il elle lui somebody someone everyone everybody jemand alguien quelqu",
    "WHO": "whoever who anyone wer quien quienes quiconque celui boss supervisor manager colleague neighbour neighbor operator reviewer rater chef kollege kollegin nachbar jefe jefa colega vecino patron collegue voisin guy man woman bloke typ kerl tipo type mec",
    "BE": "be am is are was were been being re s bin bist ist sind seid war waren eres es son somos sois soy era fue est sont etes suis",
    "NEG": "not no never none dont doesnt didnt wont cant cannot isnt arent wasnt shouldnt wouldnt nicht kein keine keinen keiner nie niemals nunca jamas ne n pas jamais ni",
    "NOBODY": "nobody noone keiner niemand nadie personne",
    "WILL": "will ll wanna gonna going shall werde werden wirst wird voy vamos vais allons",
    "WOULD": "would wurde wurden could",
    "WANT": "want wanna love need cant would wish imagine dream will mochte mag quiero quisiera querria deseo veux voudrais aimerais adorerais",
    "SHOULD": "should ought must shouldve oughta sollte sollten soll muss mussen musste gehort gehoren debe deben deberia deberias deberian habria hay faut faudrait doit devrait devraient let",
    "WISH": "hope hopefully wish hoffe hoffentlich wunschte wunsche ware ojala espero deseo espere esperons vivement souhaite pourvu",
    "DEAD": "dead tot muerto muerta muertos mort morte",
    "DESERVE": "deserve deserves deserved verdient gehorst gehort verdienen merece merecen mereces merite merites meritent",
    "DET": "a an the this that these those such some all every only just another what so ein eine einen einem einer der die das den dieser diese dieses solche solch alle un una unos unas el la los las este esta esos esas estos ese que une le les ce cet cette ces quel quelle quels quelles de du des tous todos todas todo toda of",
    "THAT": "those these such solche diese alle jene esos esas estos estas todos ces tous",
    "VERY": "so too such very really total totally completely complete absolute absolutely utter really just always all born nothing but more like zu sehr total so echt wirklich immer nur muy tan demasiado siempre mas tres trop vraiment completement toujours que plus",
    "LITTLE": "little old big young small kleiner kleine kleines alter alte altes pequeno pequena viejo vieja petit petite vieux vieille",
    "LIKE": "like wie como comme",
    "PREP": "in into to onto over in ins im zur zum auf en al a dans au aux sur",
    "POS_UNDER": "under beneath below inside between up down unter zwischen bajo debajo entre dentro sous dessous entre",
    "WITHOUT": "without ohne sin sans nothing nichts nada rien",
    "OUT": "out away off back raus weg zuruck fuera dehors",
    "WHY": "why wieso warum pourquoi porque",
    "OR": "or sonst oder o ou else otherwise",
    "IF": "if when once wenn falls si cuando quand",
    "AGAIN": "again wieder another otra encore",
    "KNOW": "know weiss se conozco sais",
    "WHERE": "where wo donde ou",
    "LIVE": "live lives park parks sleep sleeps work works wohnst wohnt parkst schlafst vives vive aparcas duermes habites habite dors gares",
    "SELF": "yourself yourselves dich euch te suicide",
    "FAMILY": "mother mom mum sister wife daughter family kids mutter schwester frau tochter familie kinder madre hermana mujer hija familia hijos mere soeur femme fille famille enfants",
    "GOOD": "good great nice sweet hot sexy tight big huge perfect geil geile geilen heiss heisse buena bueno ricas rica bonne bonnes belles chaude",
    "NUDES": "nudes nacktbild nacktbilder nacktfoto nacktfotos dickpic dickpics",
    "PIC": "picture pictures photo photos pic pics video videos selfie selfies nudes bilder fotos bild foto imagenes images",
    "SEND": "send show sent schick schicke zeig manda mandame envia enviame muestrame ensename ensenanos envoie montre",
    "SEE": "see saw watch watched watching stare stared staring film films filming filmed peek look looked looking imagine imagined imagining glotz gafft starrte filmt sehe mira miraba mirando grababa graba regarde regardait mate matait filme",
    "KNEES": "knees knien knie rodillas genoux",
    "BED": "bed bett cama lit",
    "BEHIND": "behind hinten detras atras derriere",
    "INSIDE": "inside drin dentro dedans",
    "HOME": "home again tomorrow alive nach hause casa",
    "LAST": "walk see wake breathe live leave reach come",
    "BIRTH": "birth geburt nacimiento naissance",
    "EACH": "one whole every last each lot",
    "GO": "go geh geht fahr verpiss ve vete vuelve vayanse lárgate largate va vas rentre rentrez retourne retournez degage dégage crawl",
    "BACK": "back zuruck dahin wieder vuelta chez",
    "PLACE": "country land home heimat hole loch pais agujero pays trou jungle dschungel selva zoo",
    "ONLY": "only real normal decent proper echte nur solo sólo gente seulement vrais",
    "FOR": "for fur para por pour",
    "ALIVE": "alive breathing born exist lebst geboren nacido vivo viva ne",
    "CRY": "cry weep miss mourn care weinen heulen trauern vermissen vermisst wein llorar llora llorara echar pleurer pleurera pleurerait pleure manquer regrettera",
    "LESS": "less fewer weniger menos moins",
    "JOB": "jobs job work women wives money arbeit frauen geld trabajo mujeres travail femmes",
    "COLOUR": "dark old brown black yellow foreign disabled crippled fat schwarzen alten braunen dunklen viejos oscuros negros morenos noirs vieux bronzes",
    "KIND": "kind kinds sort sorts lot breed faith religion race skin colour color ones folk tribe sippschaft glauben glaubens gesocks rasse sorte viertel barrio fe raza calana religion foi quartier espece tribu",
    "PEOPLE": "people person persons mensch leute menschen gente personas gens",
    "THERE": "dort da ahi alli bas",
    "MOUTH": "mouth trap face gob fresse maul klappe schnauze mund boca hocico pico gueule bouche bec",
    "SHUT": "shut halt haltet cierra callate calla ferme fermez tais stfu",
    "BRAIN": "brain brains iq hirn gehirn cerebro cerveau",
    "PIECE": "piece pieces sack pile bag load stuck haufen pedazo saco monton morceau tas bout",
    "DUNG": "shit crap trash garbage filth scheisse dreck mist mierda basura merde",
    "LACK": "of like with without than zu wie kein ohne de sin d sans",
    "ABLE": "cant cannot unable zu kannst kann ni incapable even nicht",
    "TECH": "tool machine saw press part parts casting castings drill cable fixture panel motor screw bolt lever werkzeug maschine pieza maquina piece outil",
}

#: Nouns, adjectives and verbs that inflect: language, symbol, lemmas.
NOUNS = {
    "INS": {
        "en": "moron idiot imbecile cretin moronic asshole arsehole bastard bitch prick cunt twat wanker tosser dickhead dumbass jackass motherfucker fucker cocksucker scumbag dirtbag sleazebag loser halfwit dimwit nitwit numbskull dunce dipshit shithead shitface fuckface fuckwit lowlife slut whore skank slag hoe simpleton ignoramus nincompoop bellend knobhead pillock douche douchebag schmuck "
              "deadbeat weirdo psycho pervert degenerate spastic sucker lardass fatso airhead bonehead blockhead knucklehead buffoon bimbo crackhead trollop crybaby",
        "de": "idiot vollidiot trottel depp arschloch arschgeige wichser hurensohn missgeburt mistkerl drecksack drecksau dreckschwein scheisskerl schwachkopf dummkopf hohlkopf vollpfosten versager penner spast spasti kretin schlampe hure nutte fotze flachzange lusche waschlappen schlappschwanz blodmann blodian bastard schweinehund miststuck wixer loser assi opfer pfeife nichtsnutz taugenichts",
        "es": "idiota puta imbecil gilipollas cabron cabrona pendejo pendeja pelotudo boludo tarado tarada mamon capullo cretino subnormal hijoputa hijueputa malnacido desgraciado zopenco baboso zorra puton furcia fulana maricona cerdo_asqueroso payaso_de_mierda estupido imbeciles soplapollas comemierda lameculos mequetrefe mongolo retrasado inutil fracasado escoria",
        "fr": "idiot idiote imbecile connard connasse conne salaud salope enculé encule fumier ordure abruti abrutie debile cretin cretine batard encule salopard enfoire bouffon boulet tocard minable raclure pouffiasse petasse garce pute putain trouduc trou_du_cul couillon branleur tete_de_noeud attarde demeure gogol mongol",
    },
    "MILD": {
        "en": "retard retards pig swine cow dog rat worm snake toad monkey ape donkey sheep weasel maggot leech parasite clown fool oaf slob creep freak coward wimp liar trash garbage scum dirt filth waste shit crap joke disgrace failure dolt hag witch vermin animal nobody zero brat dwarf troll ass arse fuck jerk wuss sissy twit mutt mongrel rodent turd pussy hick redneck bugger",
        "de": "schwein sau hund ratte wurm schlange kuh ziege affe esel parasit clown feigling null abschaum dreck mull abfall tier niete lappen ekel schande hexe zwerg arsch sack furz wicht lump schuft luder gans pute trampel pflaume memme",
        "es": "cerdo cerda perro perra rata gusano burro mono vaca payaso cobarde basura mierda bobo tonto necio parasito animal bruja vaga vago verguenza culo pedo sanguijuela cucaracha patan bestia lerdo memo",
        "fr": "porc cochon truie chien chienne rat ver serpent vache ane singe clown lache parasite dechet merde con incapable nul andouille larve clochard honte sorciere cul cafard sangsue dinde morue gourde cloche plouc minus",
    },
    "SLUR": {
        "en": "nigger nigga faggot fag dyke tranny kike spic chink gook wetback raghead towelhead paki coon gypo cripple darkie beaner homo",
        "de": "neger kanake kanacke schwuchtel zigeuner kruppel schlitzauge kameltreiber tunte transe fidschi polacke mongo",
        "es": "sudaca maricon marica moraco negrata bollera travelo tullido lisiado panchito gabacho",
        "fr": "negre bougnoule bicot youpin pede tapette tarlouze gouine niakoue romano travelo boiteux feuj",
    },
    "GRP": {
        "en": "immigrant migrant refugee foreigner alien gay lesbian homosexual jew muslim arab black african asian mexican latino indian pakistani turk pole romanian gypsy roma catholic christian hindu woman female girl transgender trans queer disabled pensioner elder native jewess islamist chinese white blonde feminist",
        "de": "auslander fluchtling migrant asylant asylbewerber schwule lesbe jude muslim moslem araber schwarze afrikaner turke pole rumane zigeuner weib frau behinderte homosexuelle rentner chinese madchen",
        "es": "inmigrante migrante refugiado extranjero gay lesbiana judio musulman moro arabe negro africano chino mexicano gitano mujer discapacitado homosexual anciano viejo rumano indio",
        "fr": "immigre migrant refugie etranger gay lesbienne juif musulman arabe noir africain chinois gitan rom femme handicape infirme homosexuel vieux turc roumain",
    },
    "DEHUM": {
        "en": "vermin parasite cockroach rat maggot locust leech pest plague disease cancer infestation scum filth dirt trash garbage savage barbarian animal beast subhuman untermensch monkey ape pig dog insect virus dregs inferior monster criminal rapist terrorist thief thieves thug",
        "de": "ungeziefer parasit kakerlake ratte made schmarotzer plage pest seuche krankheit krebs abschaum dreck mull pack gesindel wilde barbar tier bestie untermensch affe schwein hund viren untermenschlich kriminelle dieb terrorist verbrecher",
        "es": "plaga peste parasito cucaracha rata alimana escoria basura mugre salvaje barbaro animal bestia subhumano mono cerdo perro cancer enfermedad delincuente chusma ladron terrorista",
        "fr": "vermine parasite cafard rat sangsue peste fleau maladie cancer racaille ordure dechet sauvage barbare animal bete sous-homme singe porc chien nuisible criminel voleur terroriste",
    },
    "BODY": {
        "en": "finger throat wrist face head neck skull tooth teeth leg arm bone hand knee eye nose jaw rib spine back gut ear stomach toe kneecap thumb tongue lung ball heart liver ass arse",
        "de": "finger kehle handgelenk gesicht kopf hals genick schadel zahn zahne bein arm knochen hand hande auge nase kiefer rippe zunge fresse schnauze knie",
        "es": "dedo garganta muneca cara cabeza cuello craneo diente pierna brazo hueso mano ojo nariz mandibula costilla lengua rodilla boca crisma",
        "fr": "doigt gorge poignet visage tete cou crane dent jambe bras os main oeil yeux nez machoire cote langue genou gueule",
    },
    "DEVICE": {
        "en": "furnace oven kiln press chamber incinerator shredder grinder crusher saw boiler acid gallows ditch grave river camp fire gas cage vat booth",
        "de": "ofen presse gaskammer lager schredder sage verbrennungsofen grab kessel saure feuer gas kafig",
        "es": "horno prensa camara incinerador trituradora sierra tumba caldera acido fuego hoguera gas jaula",
        "fr": "four presse chambre incinerateur broyeur scie tombe chaudiere acide feu fournaise gaz cage",
    },
    "CLOTHES": {
        "en": "skirt blouse shirt dress bra panties pants trousers jeans underwear coat apron overall clothes clothing underclothes",
        "de": "rock bluse hemd kleid bh hoschen hose unterwasche kittel kleider klamotten schurze",
        "es": "falda blusa camisa vestido sujetador braga pantalon ropa bata delantal",
        "fr": "jupe chemisier chemise robe soutif culotte pantalon vetement blouse tablier fringue",
    },
    "PRIVATE": {
        "en": "thigh leg hip crotch waist chest lap lip neck body curves",
        "de": "schenkel bein hufte schritt brust korper",
        "es": "muslo pierna cadera entrepierna pecho cuerpo",
        "fr": "cuisse jambe hanche entrejambe poitrine corps",
    },
    "LEWD": {
        "en": "tit titty boob breast nipple cock dick pussy cunt clit penis vagina ass arse butt cum boner dildo blowjob handjob orgasm porn nude",
        "de": "titte brust brustwarze nippel schwanz muschi fotze arsch penis scheide hintern busen orgasmus porno",
        "es": "teta pezon polla verga cono culo pene vagina orgasmo porno pechuga",
        "fr": "nichon sein teton bite queue chatte cul penis vagin orgasme porno fesse",
    },
}

#: Adjectives that degrade persons, expletives, and states of undress and arousal.
ADJECTIVES = {
    "ADJ": {
        "en": "stupid dumb idiotic moronic brainless braindead brain-dead mindless clueless thick dense dimwitted retarded lazy filthy dirty disgusting pathetic worthless useless ugly fat vile wretched rotten stinking spineless gutless lousy miserable hopeless incompetent greasy smelly repulsive sick twisted inferior subhuman creepy nasty crazy insane lying primitive illiterate inbred cowardly slimy",
        "de": "dumm blod bescheuert bekloppt hirnlos behindert zuruckgeblieben faul dreckig schmutzig widerlich ekelhaft erbarmlich wertlos nutzlos hasslich fett feige mies jammerlich ruckgratlos unfahig stinkend ekelig minderwertig krank primitiv verlogen",
        "es": "estupido tonto idiota descerebrado retrasado vago perezoso sucio guarro asqueroso repugnante patetico inutil feo gordo cobarde miserable apestoso inmundo inferior enfermo mentiroso primitivo",
        "fr": "stupide bete idiot debile decerebre attarde paresseux faineant sale crasseux degoutant repugnant pathetique inutile moche gros grosse lache miserable minable puant immonde ignoble inferieur malade pauvre menteur primitif",
    },
    "EXPL": {
        "en": "fucking fuckin freaking goddamn damn bloody motherfucking fucked",
        "de": "verdammt verflucht verfickt beschissen scheiss verschissen elend",
        "es": "puto jodido maldito pinche puta",
        "fr": "putain foutu maudit sacre",
    },
    "NAKED": {"en": "naked nude topless undressed", "de": "nackt", "es": "desnudo", "fr": "nu nue nus nues"},
    "HORNY": {"en": "horny aroused randy turned-on begging unzipped", "de": "geil scharf spitz", "es": "cachondo caliente", "fr": "excite bandant"},
    "STINK": {"en": "greedy inferior primitive dirty filthy stupid lazy criminal dangerous dishonest disgusting violent", "de": "dreckig faul dumm kriminell gefahrlich", "es": "sucio vago criminal ladron", "fr": "sale voleur criminel dangereux"},
}

VERBS = {
    "KILL": {
        "en": "kill murder slaughter strangle behead stab lynch execute gas exterminate eradicate rape hang drown shoot choke butcher gut torture hunt annihilate wipe neuter sterilise sterilize castrate",
        "de": "toten umbringen ermorden abschlachten erwurgen erstechen erstochen erschossen aufgehangt erhangt erschiessen vergasen ausrotten vergewaltigen aufhangen erhangen ersaufen kopfen abknallen kaltmachen foltern vernichten totschlagen abstechen uberfahren",
        "es": "matar asesinar estrangular degollar apunalar linchar fusilar exterminar violar ahorcar ahogar torturar aniquilar rajar gasear atropellar reventar",
        "fr": "tuer assassiner etrangler egorger poignarder lyncher fusiller exterminer violer pendre noyer torturer gazer buter crever",
    },
    "HIT": {
        "en": "break smash beat punch kick slap crush burn cut drag shove hit knock rip tear bash whip bury flog skin twist snap bite claw crack rearrange ram",
        "de": "brechen schlagen verprugeln treten zerquetschen verbrennen schneiden schleifen stossen reissen polieren prugeln zerschlagen zertreten hauen brich",
        "es": "romper partir pegar golpear patear aplastar quemar cortar arrastrar arrancar reventar machacar destrozar rompo parto reviento",
        "fr": "casser briser frapper cogner gifler ecraser bruler couper trainer arracher defoncer demonter eclater peter fracasser",
    },
    "CAST": {
        "en": "throw lock put push shove send dump toss shut feed",
        "de": "werfen sperren stecken schicken schmeissen einsperren stossen",
        "es": "tirar encerrar meter echar arrojar lanzar",
        "fr": "jeter enfermer mettre envoyer balancer pousser foutre",
    },
    "FALL": {
        "en": "fall die choke rot suffer slip trip burn bleed drown crash jump vanish drop",
        "de": "fallen sterben ersticken verrecken leiden rutschen verbluten krepieren abkratzen sturzen stirb stirbst stirbt gefallen gestorben springen",
        "es": "caer morir pudrir sufrir ahogar sangrar reventar saltar caiga muera mueras mueran caigas cayera muriera tirar",
        "fr": "tomber mourir creve pourrir souffrir saigner glisser sauter tombait meure creves",
    },
    "SEXV": {
        "en": "fuck shag bonk deepthroat masturbate ejaculate",
        "de": "ficken bumsen vogeln wichsen",
        "es": "follar joder coger chingar cogerte mamar tirarse masturbar",
        "fr": "baiser niquer enculer sucer branler fourrer sodomiser",
    },
    "TOUCH": {
        "en": "lick kiss suck touch feel grope caress spank undress strip fondle squeeze taste rub stroke ride mount bend grab pinch unzip",
        "de": "lecken kussen saugen anfassen beruhren begrapschen griff fasste streicheln ausziehen befummeln spuren greifen versohlen auszieh",
        "es": "lamer besar chupar tocar acariciar desnudar manosear sobar agarrar desvestir lamerte meter metio",
        "fr": "lecher embrasser toucher caresser deshabiller peloter tripoter sentir palper fesser",
    },
    "MOAN": {"en": "moan groan whimper", "de": "stohnen", "es": "gemir gimio gemia gimiera", "fr": "gemir gemissait gemisse gemit"},
    "BREED": {"en": "breed multiply spread swarm infest", "de": "vermehren ausbreiten", "es": "reproducir multiplicar crian", "fr": "reproduire multiplier pullulent"},
    "STEAL": {"en": "steal rob cheat lie rape leech ruin invade destroy stink spoil poison", "de": "stehlen klauen lugen betrugen stinken zerstoren schmarotzen", "es": "robar mentir enganar apestar invadir destruir", "fr": "voler mentir tricher puer envahir detruire"},
    "BELONG": {"en": "belong deserve fit", "de": "gehoren zu-suchen verloren", "es": "pertenecer pisar pintar caber", "fr": "appartenir place faire meriter"},
    "EXPEL": {"en": "expel deport remove ban rid eliminate clean cleanse sack purge keep kick get", "de": "ausweisen abschieben entfernen rausschmeissen saubern vertreiben loswerden", "es": "expulsar deportar eliminar limpiar echar", "fr": "expulser deporter virer eliminer nettoyer debarrasser chasser"},
    "HIRE": {"en": "hire let allow employ admit trust accept import", "de": "einstellen lassen reinlassen erlauben lasst lass trauen", "es": "contratar dejar permitir dejan admitir", "fr": "embaucher laisser permettre engager laisse admettre"},
    "SERVE": {"en": "serve obey clean cook kneel", "de": "dienen gehorchen kochen putzen", "es": "servir obedecer limpiar cocinar", "fr": "servir obeir cuisiner"},
    "DECAY": {"en": "die ruin spoil rot decline worsen collapse", "de": "sterben verkommen ruinieren", "es": "morir arruinar hundir", "fr": "mourir ruiner pourrir"},
    "REPORT": {
        "en": "report forbid prohibit complain train define quote punish ban discipline remind", "de": "melden verbieten beschweren ahnden bestrafen untersagen",
        "es": "denunciar prohibir comunicar sancionar", "fr": "signaler interdire denoncer sanctionner"},
}
#: Nouns of speech about misconduct.
REPORT = "rule rules policy complaint complaints harassment remark remarks comment comments misconduct training definition insults slurs hateful sexist racist jokes conduct regel richtlinie belastigung beleidigung beleidigungen schulung verboten gemeldet acoso insultos norma regla prohibido reglamento regle reglement harcelement insultes interdit interdits propos"

#: Parts of insulting compounds.
COMPOUNDS = {
    "en": ("ass arse dip shit fuck dick dumb cock scum douche fat meat knuckle bone block num", "hole head face wit wad bag hat brain tard sucker clown stain"),
    "de": ("scheiss dreck drecks arsch voll sau schweine huren mist fick hohl schwach dumm blod", "kerl sack schwein loch idiot sohn hund weib geige gesicht fresse vieh depp trottel kopf tochter sau stuck bratze pack honk"),
}

_ENDS = {
    ("noun", "en"): ("", "s", "es"), ("noun", "de"): ("", "s", "e", "en", "n", "er", "ern", "es"), ("noun", "es"): ("", "s", "es"), ("noun", "fr"): ("", "s", "x", "e", "es"),
    ("adj", "en"): ("", "er", "est", "ly"), ("adj", "de"): ("", "e", "en", "er", "es", "em"), ("adj", "es"): ("", "s", "es"), ("adj", "fr"): ("", "s", "e", "es", "x"),
}


def forms(kind: str, language: str, lemma: str) -> Iterator[str]:
    """Inflected forms of a lemma; some do not occur, which does no harm."""
    if kind != "verb":
        for e in _ENDS[kind, language]:
            yield lemma + e
        if language == "en" and lemma.endswith("y"):
            yield lemma[:-1] + "ies"
        if lemma == "woman":
            yield "women"
        if language == "es" and lemma[-1] in "oa":
            yield from (lemma[:-1] + e for e in ("o", "a", "os", "as"))
            if kind == "adj":
                yield lemma[:-1] + "isimo"
        if language == "de" and kind == "noun" and lemma.endswith("e"):
            yield from (lemma + "n", lemma)
        return
    yield lemma
    if language == "en":
        yield from (lemma + e for e in ("s", "es", "ed", "ing"))
        if lemma.endswith("e"):
            yield from (lemma + "d", lemma[:-1] + "ing")
        if lemma.endswith("y"):
            yield from (lemma[:-1] + "ied", lemma[:-1] + "ies")
        if len(lemma) > 2 and lemma[-1] not in "aeiouwxy" and lemma[-2] in "aeiou":
            yield from (lemma + lemma[-1] + "ed", lemma + lemma[-1] + "ing")
        yield from IRREGULAR.get(lemma, "").split()
    elif language == "de" and lemma.endswith("n"):
        root = lemma[:-2] if lemma.endswith("en") else lemma[:-1]
        yield from (root + e for e in ("", "e", "st", "t", "te", "ten", "est"))
        yield "ge" + root + "t"
        yield "ge" + lemma
    elif language == "es" and lemma[-2:] in ("ar", "er", "ir"):
        root, first = lemma[:-2], lemma[-2] == "a"
        ends = "o as a amos an ado ada ados adas ando e es en aba are" if first else "o es e emos en ido ida idos idas iendo a an ia ere"
        yield from (root + e for e in ends.split())
        for c in "te me lo la le se os nos los las les telo melo".split():
            yield lemma + c
    elif language == "fr" and lemma[-2:] in ("er", "ir", "re"):
        root = lemma[:-2]
        yield from (root + e for e in ("e", "es", "ent", "ez", "ait", "a", "ant", "s", "t", "is", "it", "i", "u", "us", "ees", "erai", "era", "ons"))


#: Irregular English forms.
IRREGULAR = {
    "break": "broke broken", "beat": "beaten", "throw": "threw thrown", "hang": "hung hanged", "shoot": "shot", "tear": "torn tore", "drown": "drowned", "steal": "stole stolen", "get": "got gotten getting",
    "keep": "kept", "burn": "burnt", "fall": "fell fallen", "die": "dying", "choke": "choked", "send": "sent", "lie": "lying", "feel": "felt", "bend": "bent", "feed": "fed", "put": "putting", "let": "letting", "rid": "rids",
    "bite": "bit bitten", "fuck": "fuckin", "ban": "banned", "slip": "slipped", "forbid": "forbidden", "ride": "rode riding", "drag": "dragged", "gas": "gassed gassing", "breed": "bred", "spread": "spreading", "cut": "cutting", "serve": "servants servant",
}


def words() -> Iterator[tuple[str, str]]:
    """Every form with its symbol."""
    for s, ws in FIXED.items():
        yield from ((w, s) for w in ws.split())
    for kind, lists in (("noun", NOUNS), ("adj", ADJECTIVES), ("verb", VERBS)):
        for s, by_language in lists.items():
            for language, lemmas in by_language.items():
                for lemma in lemmas.split():
                    yield from ((f, s) for f in forms(kind, language, lemma.replace("-", "").replace("_", "")))
    for s, act in (("KILL", "HARMYOU"), ("HIT", "HARMYOU"), ("TOUCH", "SEXYOU"), ("SEXV", "SEXYOU")):  # Spanish verbs with their object
        yield from ((lemma + c, act) for lemma in VERBS[s]["es"].split() if lemma[-1] == "r" for c in ("te", "os"))
    yield from ((w, "REPORT") for w in REPORT.split())
    for language, (heads, tails) in COMPOUNDS.items():
        for a in heads.split():
            for b in tails.split():
                yield from ((f, "INS") for f in forms("noun", language, a + b))
