"""Abusive, hateful or sexual language, scored by a weighted finite-state grammar over clauses.

Four stages are composed (``transduce.py``).  The lexical one undoes disguises and reads each word as the
symbols of ``lexicon.py``, through inflection and compounds.  The phrase transducer reads those into insulting
names, groups, persons' bodies, acts.  The clause transducers (insult, threat, wish of harm, degradation of a
group, sexual content) read phrases and words with bounded gaps and write a weighted match.  The context
transducer reads matches together with negation and speech about misconduct and takes weight back.  No word
alone makes a case, except names that have no other use.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import lexicon
from .naming import drops, one_slip
from .plaintext import fold, unmarked
from .transduce import Symbols, Transducer

#: A document is a case from this score on.
CASE = 0.85

#: Phrases: the symbol written, its weight, the words read (see ``transduce.Rule``).
PHRASES = [
    ("NAME", 0.0, "INS|SLUR"), ("NAME", 0.2, "ADJ|EXPL+ INS|SLUR"), ("NAME", 0.2, "INS|ADJ de EXPL|MILD"), ("NAME", 0.2, "PIECE of? de? DUNG"), ("NAME", 0.2, "bunch|pack|gang|bande|haufen|panda|manada|PIECE of|de|von? DET* ADJ* INS|SLUR|MILD"),
    ("NAME", 0.2, "waste of space|air|oxygen|skin"), ("NAME", 0.2, "son|sons|hijo|hija|hijos|fils|fille of|de a? bitch|whore|puta|perra|pute|chienne"),
    ("LOW", 0.0, "ADJ|EXPL+ LITTLE* MILD"), ("LOW", 0.0, "LITTLE ADJ|EXPL+ MILD"), ("NAME", 0.2, "ADJ|EXPL+ LITTLE+ INS|SLUR"), ("LOW", 0.1, "ADJ ADJ+ MILD"), ("LOW", 0.1, "EXPL ADJ MILD"),
    ("PLAIN", 0.0, "MILD|ADJ"),
    ("GROUP", 0.0, "GRP|SLUR"), ("GROUP", 0.0, "the|die|los|les|THAT COLOUR KIND"), ("GROUP", 0.0, "HIS|THAT|that|Y KIND"),
    ("GROUP", 0.0, "PEOPLE|THAT|los|die|ceux|gens of|with|from|de|mit|a|von THAT|that|this|HIS|ese|esa|este|cette|ce|ihrem|la KIND|THERE"),
    ("GROUP", 0.0, "the|that|THAT -2 lot|sippschaft|gesocks"), ("GROUP", 0.0, "THAT PEOPLE"), ("GROUP", 0.0, "PEOPLE LIKE Y|THEY|THAT"),
    ("YBODY", 0.1, "Y DET? BODY"), ("YBODY", 0.0, "Y los|las|la|el|le|les|die|den|das|ins BODY"),
    ("YMOUTH", 0.0, "Y|die|das|la|el|los|the DET? ADJ|EXPL* MOUTH"),
    ("HISBODY", 0.0, "HIS|Y|ME|la|el|den|die|seinen|ses ADJ|NAKED|EXPL? PRIVATE|LEWD|CLOTHES"),
    ("NEVER", 0.0, "NEG|NOBODY"),
    ("INTEND", 0.0, "I WILL"), ("INTEND", 0.0, "I be? am|m going|gonna to?"), ("INTEND", 0.0, "I WANT|WOULD to?"), ("INTEND", 0.0, "ich dir|dich|euch"), ("INTEND", 0.0, "voy|vamos a"), ("INTEND", 0.0, "je|on te|vous|vais"), ("INTEND", 0.0, "WILL I"),
    ("SUBJ", 0.0, "YSUBJ"), ("YARE", 0.0, "YSUBJ PEOPLE|all|guys|lot|two? BE"), ("YARE", 0.0, "eres|sois|bist|seid|etes"), ("DESIRE", 0.0, "I WANT|WILL|WOULD"), ("DESIRE", 0.0, "WANT|quiero|mochte I|te|you"), ("DESIRE", 0.0, "WANT|WILL te|dich"), ("DESIRE", 0.0, "want|wanna|quiero|veux|mochte|let to?"),
]

#: Clauses: what is matched, its weight, the words and phrases read.
CLAUSES = [
    # insults with a person as their target
    ("INSULT", 1.0, "BE SUBJ VERY* retarded|stupid|dumb|braindead|behindert|bescheuert|blod|imbecil|debile|idiot|con|conne"), ("INSULT", 1.0, "was fur ein|eine -1 NAME|LOW"), ("INSULT", 1.0, "was fur INS"), ("INSULT", 1.0, "you suck|stink|disgust"), ("INSULT", 1.0, "du stinkst|nervst|ekelst"), ("INSULT", 1.0, "I hate|hates|despise|despises|loathe Y"), ("INSULT", 1.0, "te|t odio|deteste|hais|desprecio"), ("INSULT", 1.0, "je te hais|meprise|deteste"), ("INSULT", 1.0, "ich hasse|verachte dich|euch"), ("INSULT", 1.0, "NEG|nichts -1 wert"), ("INSULT", 1.0, "no vales|sirves -2 nada"), ("INSULT", 1.0, "ne vaux|vaut|sers -2 rien"), ("INSULT", 1.0, "eat|friss|come|mange shit|scheisse|mierda|merde"), ("INSULT", 1.0, "kiss|bite my ass|arse"), ("INSULT", 1.0, "kotzt mich an"), ("INSULT", 1.0, "que te den"), ("INSULT", 1.0, "hau|zieh ab|leine NAME|LOW|MILD"), ("INSULT", 1.0, "get lost -2 NAME|LOW|MILD"), ("INSULT", 1.0, "drop dead"), ("INSULT", 1.0, "casse toi -1 NAME|LOW|MILD"), ("INSULT", 1.0, "piss|bugger|sod off"), ("INSULT", 1.0, "vete|va|geh al|au|zum diablo|carajo|diable|teufel"), ("INSULT", 1.0, "shame on you -2 NAME|LOW|MILD"), ("INSULT", 1.0, "you -1 amount to nothing"), ("INSULT", 1.0, "you worthless|useless|pathetic|disgusting|stupid|filthy|miserable|ugly"),
    ("INSULT", 1.0, "Y BRAIN BE -3 small|smaller|tiny|rotten|kleiner|pequeno|petit"), ("INSULT", 1.0, "ADJ fuck|fucks"),
    ("INSULT", 1.0, "YARE DET* VERY* ADJ PEOPLE|man|guy|woman|thing"), ("INSULT", 1.0, "YARE DET? PEOPLE VERY* ADJ"), ("INSULT", 1.0, "SUBJ -1 INS|SLUR"), ("INSULT", 1.0, "du|ihr MILD|DEHUM"), ("INSULT", 1.0, "ta|vos gueule|gueules"),
    ("INSULT", 1.0, "YARE -2 VERY* NAME"), ("INSULT", 1.0, "YARE VERY* DET* VERY* LOW"), ("INSULT", 1.0, "YARE VERY* DET+ VERY* MILD"), ("INSULT", 1.0, "YARE DET VERY* ADJ EXPL? MILD"), ("INSULT", 1.0, "YARE VERY* ADJ"), ("INSULT", 1.0, "YARE VERY+ ADJ"),
    ("INSULT", 1.0, "SUBJ VERY* NAME"), ("INSULT", 1.0, "SUBJ LOW"), ("INSULT", 1.0, "Y ADJ NAME|MILD"), ("INSULT", 1.0, "BE SUBJ VERY* DET? NAME|LOW"),
    ("INSULT", 0.95, "ADJ|EXPL+ INS|SLUR"), ("INSULT", 1.0, "DET VERY* ADJ|EXPL+ NAME"), ("INSULT", 1.0, "what|such|so|only|just|que|quel|quelle|solch|menudo|vaya DET* VERY* NAME"), ("INSULT", 1.0, "WHO -6 BE DET* VERY* NAME|LOW"), ("INSULT", 1.0, "WHO -6 BE VERY* ADJ"), ("INSULT", 1.0, "ONE BE DET* VERY* NAME|LOW"),
    ("INSULT", 1.0, "what|such|only|just|this|que|quel|quelle|so DET* LOW"), ("INSULT", 1.0, "DET* INS SUBJ|de"), ("INSULT", 1.0, "INS WHO|ONE|everyone|everybody"), ("INSULT", 1.0, "PIECE of? de? DUNG"),
    ("INSULT", 1.0, "waste of space|air|oxygen|skin"), ("INSULT", 1.0, "son|sons|hijo|hija|hijos|fils of|de a? bitch|whore|puta|perra|pute"), ("INSULT", 1.0, "INS|ADJ de mierda|merde"), ("INSULT", 1.0, "pauvre|sale|gros|grosse|espece de|d? INS|MILD|type|ADJ"),
    ("INSULT", 1.0, "Y -6 BRAIN LACK|LIKE DET* -2 MILD|sponge|potato|stone|brick|goldfish|flea|peanut|amoeba|vegetable|door|rock|stein|brot|mosquito|huitre"), ("INSULT", 0.7, "Y -3 BRAIN LACK"), ("INSULT", 1.0, "Y -2 no|kein|sin|pas BRAIN"), ("INSULT", 1.0, "too|zu|demasiado|trop ADJ to|um|zum|para|pour -3 breathe|live|exist|read|think|leben|atmen|denken|vivir|pensar|respirer|penser"),
    ("INSULT", 1.0, "SHUT -2 fuck|hell up"), ("INSULT", 1.0, "SHUT YMOUTH"), ("INSULT", 1.0, "SHUT up? te? -1 NAME|LOW|MILD"), ("INSULT", 1.0, "GO -2 to|zur|in|into|al|a|en|au Y? -2 hell|holle|teufel|infierno|diablo|mierda|enfer|diable|hole|cave|loch|agujero|trou"), ("INSULT", 1.0, "verpiss|vaffanculo|fuck|piss|va off|dich|te|tu faire? -1 foutre?"),
    ("INSULT", 1.0, "nobody|noone|everyone|everybody|keiner|niemand|jeder|nadie|todos|personne likes|loves|hates|mag|hasst|quiere|odia|aime|deteste Y"), ("INSULT", 1.0, "SUBJ|Y make|makes me|us sick|vomit|puke"), ("INSULT", 1.0, "me|das|tu|du das? asco|asqueas|degoutes|ekelst|widerst ME?"), ("INSULT", 1.0, "fuck|screw|damn|fick|chinga|jodete|jodeos|nique Y|off|dich|te|ta|tu"), ("INSULT", 1.0, "jodete|jodeos|chingate|vetealcarajo|stfu|kys|gtfo"),
    ("INSULT", 1.0, "Y FAMILY BE -3 INS|LOW|MILD|SLUR"), ("INSULT", 0.9, "YARE VERY* NEG? worth -2 nothing|dreck|nada|rien|shit"), ("INSULT", 1.0, "YARE nothing|nada|rien but|mas|als|que -2 NAME|MILD|LOW"), ("INSULT", 0.9, "fucking|fuckin|verfickter|verfickte|verdammter|puto|pinche MILD"), ("INSULT", 0.4, "NAME"), ("INSULT", 0.9, "SLUR"), ("INSULT", 1.0, "look|mira|regarde|schau at? DET* LOW"),
    ("INSULT", 1.0, "SUBJ should|sollt|sollst be ashamed of? existing|living"), ("INSULT", 1.0, "lick|kiss|leck|besa|lame|chupa|suck|embrasse my|mein|meinen|mi|me|mon LEWD|BODY"), ("INSULT", 1.0, "YARE -1 WITHOUT|less|kein|sin|sans BRAIN|value|worth"),
    # threats
    ("THREAT", 1.0, "beat|kick|knock|scare|punch|smash DET* crap|shit|hell|daylights|stuffing out of Y"), ("THREAT", 1.0, "INTEND|we|im|are coming for Y"), ("THREAT", 1.0, "Y BE next"), ("THREAT", 1.0, "INTEND -1 end|finish|destroy|ruin YSUBJ|te|dich"), ("THREAT", 1.0, "make Y -1 bleed|suffer|scream|pay|sorry"), ("THREAT", 1.0, "INTEND -2 have|bring|get -1 gun|knife|rifle|messer|pistola|couteau"), ("THREAT", 1.0, "shoot|blow|burn up|down -1 everyone|office|place|plant|school|Y"), ("THREAT", 1.0, "Y days|tage|dias|jours BE|estan|sont -1 numbered|gezahlt|contados|comptes"), ("THREAT", 1.0, "you better run|hide"), ("THREAT", 1.0, "dead man|meat"), ("THREAT", 1.0, "krieg|kriegen|kriege dich"), ("THREAT", 1.0, "wir|ich finden|finde dich"), ("THREAT", 1.0, "te voy|vamos a encontrar"), ("THREAT", 1.0, "je|on te retrouverai|retrouvera|retrouver"), ("THREAT", 1.0, "faire|fais la peau"), ("THREAT", 1.0, "BE|estas|estais muerto|muerta"), ("THREAT", 1.0, "cuida tu espalda"), ("THREAT", 1.0, "teach Y -1 lesson -4 HIT|KILL"),
    ("THREAT", 1.0, "burn|blow|torch HIS|Y -1 house|car|home|family"),
    ("THREAT", 1.0, "INTEND -2 CAST -1 Y -3 DEVICE"), ("THREAT", 1.0, "INTEND -2 HARMYOU"), ("THREAT", 1.0, "quiero|vamos|hay -2 HARMYOU"),
    ("THREAT", 1.0, "INTEND -4 KILL -3 Y|ONE|FAMILY|THEY|NAME|GROUP"), ("THREAT", 1.0, "INTEND -3 Y -3 KILL"), ("THREAT", 1.0, "INTEND -5 HIT|CAST|KILL -4 YBODY"), ("THREAT", 1.0, "INTEND beat|punch|smash|slap|kick|crush|bury|whip|skin|verprugle|schlage|pego|frappe|cogne|defonce|eclate YSUBJ|te|dich|ONE"), ("THREAT", 1.0, "HIT|KILL I -1 Y -6 BODY"), ("THREAT", 1.0, "HIT|KILL I Y -6 BODY|um|ab|tot|zusammen|aus"),
    ("THREAT", 1.0, "Y KILL"), ("THREAT", 1.0, "KILL Y"), ("THREAT", 1.0, "te|os|le|les voy|vamos a HIT|KILL"), ("THREAT", 1.0, "te|os|vous HIT los|las|la|el|les|le|tous? BODY"), ("THREAT", 1.0, "OR -2 I? INTEND? -2 HIT|KILL -3 Y"), ("THREAT", 1.0, "OR HIT I Y"), ("THREAT", 1.0, "SHUT -4 OR -4 HIT|KILL"),
    ("THREAT", 1.0, "HIT|CAST -4 down|up|durch|por|dans -1 Y DET? throat|ass|arse|kehle|garganta|gorge|cul|culo|arsch"), ("THREAT", 1.0, "slit|rip YBODY"), ("THREAT", 1.0, "put|stick|jag|jage|mete|meter|mettre|plant -2 bullet|knife|kugel|messer|bala|cuchillo|balle|couteau -3 Y|ONE|HIS"), ("THREAT", 1.0, "INTEND -4 HIT DET* BODY in|of|im|de Y"), ("THREAT", 1.0, "HIT -2 face|head|skull|teeth against|on|into|in"), ("THREAT", 1.0, "HIT Y until|bis|hasta|jusqu"), ("THREAT", 1.0, "KNOW -1 WHERE Y LIVE"), ("THREAT", 1.0, "WHERE Y LIVE"), ("THREAT", 1.0, "set|light|burn Y -4 fire|down|alive"), ("THREAT", 1.0, "Y -3 on fire with|while Y"),
    ("THREAT", 1.0, "make|sorge sure|dafur -1 Y -2 NEG -2 LAST|nach|HOME"), ("THREAT", 1.0, "Y -2 wont|never|nie|no|not LAST -3 HOME|again|tomorrow|alive"), ("THREAT", 1.0, "Y -2 BE -1 dead|tot|muerto|muerta|muertos|mort|morte"), ("THREAT", 1.0, "Y -2 will regret|bereuen|arrepentir|regretter"), ("THREAT", 1.0, "Y will pay|bleed|suffer|die|scream|beg"), ("THREAT", 1.0, "WILL|going to? find Y and"), ("THREAT", 1.0, "vas|vais|va a? pagar|morir|mourir|crever|payer|arrepentirte"),
    ("THREAT", 1.0, "wirst|werdet -3 bezahlen|sterben|bluten|bereuen|leiden"), ("THREAT", 0.9, "bring|bringe ich? dich|euch -4 um"), ("THREAT", 0.9, "mach|mache|stech|steche|schlag|schlage|knall|knalle|tret|trete ich? dich|euch|dir -4 kalt|fertig|tot|zusammen|ab|nieder|BODY"), ("THREAT", 1.0, "ich HIT dir|euch -3 BODY"), ("THREAT", 1.0, "watch your back|step"), ("THREAT", 1.0, "last|next time -4 Y -8 INTEND -3 HIT|KILL"), ("THREAT", 1.0, "ich INTEND? KILL|verprugle|verprugel|zerquetsche Y"), ("THREAT", 1.0, "INTEND -3 HIT|KILL Y|los|las|les|die|den -2 BODY"),
    # wishes of harm
    ("ILLWISH", 1.0, "Y SHOULD -2 KILL|HIT"), ("ILLWISH", 1.0, "WISH -3 Y -3 HIT|KILL|FALL"), ("ILLWISH", 1.0, "WISH -4 HIT|KILL Y"), ("ILLWISH", 1.0, "hope -4 run|runs|falls|drops over|on Y"), ("ILLWISH", 1.0, "Y SHOULD -1 FALL"), ("ILLWISH", 1.0, "kill Y self"), ("ILLWISH", 1.0, "IF only Y -2 DEAD|FALL"),
    ("ILLWISH", 1.0, "rot|burn|schmor|pudrete|pourris in|en -2 hell|holle|infierno|enfer"), ("ILLWISH", 1.0, "SHOULD -2 DEAD"), ("ILLWISH", 1.0, "WISH -2 Y -3 DEAD"),
    ("ILLWISH", 1.0, "drop dead"), ("ILLWISH", 1.0, "WISH -2 FALL Y"),
    ("ILLWISH", 1.0, "SUBJ|ONE|NAME SHOULD -1 be|have|been -1 been? KILL|HIT"), ("ILLWISH", 1.0, "SHOULD have been KILL|aborted|swallowed -3 BIRTH?"), ("ILLWISH", 1.0, "KILL at|bei|al|a la? der? BIRTH"), ("ILLWISH", 1.0, "go|just|please|geh|ve|vete|va|bitte KILL|hang|erschiess|erhang|pends SELF"), ("ILLWISH", 1.0, "KILL yourself|dich|te|yourselves"), ("ILLWISH", 1.0, "matate|suicidate|ahorcate|cuelgate|muerete|kys|pends"), ("ILLWISH", 1.0, "bring dich um"), ("ILLWISH", 1.0, "GO -1 FALL|hang|drown|die|sterben|verrecken|morir|crever|mourir"),
    ("ILLWISH", 1.0, "NOBODY WOULD|WILL|va|wird|a -1 CRY -1 Y"), ("ILLWISH", 0.7, "NOBODY -4 CRY|call|rufen|llamar|appeler"), ("ILLWISH", 1.0, "Y -2 NEG? CRY NOBODY"), ("ILLWISH", 1.0, "WISH -4 Y -3 FALL|KILL|HIT"), ("ILLWISH", 1.0, "WISH -5 FALL -3 PREP|in|into DET* DEVICE"), ("ILLWISH", 1.0, "WISH -7 HIT|FALL|open|opens|take|takes|abre -4 Y|BODY BODY|off?"), ("ILLWISH", 1.0, "WISH -6 take|takes|nimmt|arranca|prenne -1 BODY"),
    ("ILLWISH", 1.0, "WISH -6 DEVICE FALL"), ("ILLWISH", 1.0, "WISH -3 FALL -2 painfully|slowly|alone|screaming|qualvoll|sufriendo|cancer|krebs|dolor"), ("ILLWISH", 0.8, "WISH -4 FALL"), ("ILLWISH", 1.0, "WISH -4 Y|ONE -2 get|gets|kriegst|bekommst|tengas|aies|coja DEHUM|cancer|krebs|sida|aids"), ("ILLWISH", 1.0, "DESERVE -3 KILL|HIT|FALL"), ("ILLWISH", 1.0, "DESERVE -2 death|tod|muerte|mort"), ("ILLWISH", 0.8, "do us -2 favour|favor"), ("ILLWISH", 1.0, "world|welt|mundo|monde WOULD|ware|seria|serait|is -3 better|besser|mejor|mieux -1 WITHOUT Y|ONE|GROUP|THEY"),
    ("ILLWISH", 1.0, "SI|si -4 FALL -3 DEVICE"), ("ILLWISH", 1.0, "si ONE? -4 FALL PREP DET* DEVICE"), ("ILLWISH", 1.0, "que te HIT|KILL|FALL|jodan|den|follen"), ("ILLWISH", 1.0, "creve|crevez|verrecke|muere|muerete SUBJ|NAME|LOW|charogne|salope|bitch"),
    # degradation of a group
    ("DEGRADE", 1.0, "hate|despise|detest|hasse|odio|hais|loathe DET* GROUP"), ("DEGRADE", 1.0, "cant|cannot stand|bear DET* GROUP"), ("DEGRADE", 1.0, "NEG|no NEG? serve|hire|employ|trust DET* GROUP"), ("DEGRADE", 1.0, "GROUP -1 have|haben|tienen|ont no|kein|sin|pas -1 BRAIN|honour|manners|soul|respect"), ("DEGRADE", 1.0, "GROUP -1 BE -1 problem|blame|schuld|culpa|misfortune|ungluck"), ("DEGRADE", 1.0, "GROUP NEG DESERVE"), ("DEGRADE", 1.0, "GROUP -1 only|nur|solo|que want|wollen|quieren|veulent -2 money|geld|dinero|argent"), ("DEGRADE", 1.0, "GROUP go|should go home|back"), ("DEGRADE", 1.0, "NEG trust -1 GROUP"), ("DEGRADE", 1.0, "stop|fight DET* GROUP -1 invasion|plague"), ("DEGRADE", 1.0, "typical|typisch GROUP"), ("DEGRADE", 1.0, "real|echte men|manner|hombres|hommes -6 NEG GROUP"), ("DEGRADE", 1.0, "GROUP NEG BE? -1 equal|equals|normal|natural|normales"), ("DEGRADE", 1.0, "white|arische|weisse race|power|rasse -3 superior|uber|above"),
    ("DEGRADE", 1.0, "NEG want|need|like|tolerate|wollen|brauchen|queremos|voulons -2 GROUP -2 here|hier|aqui|ici|around"), ("DEGRADE", 1.0, "GROUP NEG? -2 rien|nichts|nothing|nada a|zu? -1 faire|suchen|verloren|pintan|hacer"),
    ("DEGRADE", 1.0, "GROUP -1 BE DET* VERY* ADJ|EXPL? MILD|DEHUM|NAME"), ("DEGRADE", 1.0, "GROUP -1 BE VERY* DET* ADJ"), ("DEGRADE", 1.0, "GROUP BE VERY+ STINK|ADJ"), ("DEGRADE", 1.0, "GROUP -1 NEG|no|dont|nicht -1 BELONG"), ("DEGRADE", 1.0, "GROUP BELONG NEG"), ("DEGRADE", 1.0, "GROUP -5 SHOULD -3 KILL|EXPEL"), ("DEGRADE", 1.0, "GROUP -2 SHOULD -3 CAST -3 DEVICE|cage|camp|paint"), ("DEGRADE", 1.0, "SHOULD -2 KILL|CAST|EXPEL -4 GROUP"), ("DEGRADE", 1.0, "GROUP -2 SHOULD -6 DEVICE CAST"),
    ("DEGRADE", 1.0, "KILL|gas|burn|deport|exterminate|shoot|tod|muerte|mort|death to? all? den? a? aux? DET* GROUP"), ("DEGRADE", 1.0, "keep|get|throw|kick|send|chuck -1 GROUP OUT"), ("DEGRADE", 1.0, "GROUP OUT"), ("DEGRADE", 1.0, "fuera|dehors|raus los|las|les|mit GROUP|den"), ("DEGRADE", 1.0, "rid of DET* GROUP"), ("DEGRADE", 1.0, "GROUP|THEY -2 BREED LIKE"), ("DEGRADE", 0.9, "GROUP -8 BREED"), ("DEGRADE", 0.9, "GROUP -6 STEAL -2 JOB"), ("DEGRADE", 1.0, "GROUP -1 VERY* STEAL"), ("DEGRADE", 1.0, "GROUP -10 less|fewer|weniger|menos|moins -2 to|zum|para|pour STEAL"),
    ("DEGRADE", 1.0, "NEG for|fur|para|pour DET* GROUP"), ("DEGRADE", 1.0, "DECAY -4 HIRE DET* GROUP"), ("DEGRADE", 1.0, "NEG HIRE DET* GROUP -2 touch|near|in|anfassen|tocar|toucher"), ("DEGRADE", 1.0, "WHY -2 THEY? HIRE|let -1 GROUP"), ("DEGRADE", 1.0, "HIRE GROUP near"), ("DEGRADE", 1.0, "GROUP to|zum|para|pour SERVE"), ("DEGRADE", 1.0, "GROUP -2 SHOULD -2 SERVE"), ("DEGRADE", 1.0, "GROUP -8 THEY? BE VERY* ADJ"), ("DEGRADE", 1.0, "GROUP BE -1 too|zu|demasiado|trop ADJ"), ("DEGRADE", 1.0, "GROUP -1 smell|stink|stinken|apestan|huelen|puent"),
    ("DEGRADE", 1.0, "always|immer|siempre|toujours -1 GROUP -2 ADJ"), ("DEGRADE", 1.0, "GROUP VERY+ ADJ"), ("DEGRADE", 1.0, "ADJ|EXPL|MILD GROUP"), ("DEGRADE", 1.0, "GROUP -2 BE NEG -2 PEOPLE|human|humans|menschen|humanos|humains|welcome|willkommen"), ("DEGRADE", 1.0, "GROUP -1 BE -1 less|weniger|menos|moins -1 human|wert|intelligent|smart|worth|humanos|than"), ("DEGRADE", 1.0, "GROUP GO BACK|HOME"), ("DEGRADE", 1.0, "go|geh|geht|vuelve|volved|vete|rentre|retourne|crawl back|zuruck|a|chez|dahin|to -2 Y? own? PLACE|country|came|herkommst|venido"), ("DEGRADE", 1.0, "GO back? to|in|dans|a|nach Y own? PLACE"), ("DEGRADE", 1.0, "SHOULD -2 THEY KILL"), ("DEGRADE", 1.0, "GROUP -1 NEG|no good|sirven|taugen|valent|servent|sirve|valen -2 nothing|nada|nichts|rien"), ("DEGRADE", 1.0, "send -3 THEY|GROUP|EACH -2 BACK"), ("DEGRADE", 1.0, "GROUP -4 LOSE|lose -2 BODY"), ("DEGRADE", 1.0, "no|kein|ningun|pas DET* GROUP allowed|wanted|welcome|erwunscht|ici|aqui"), ("DEGRADE", 1.0, "GROUP -3 belong|belongs|gehoren|pertenecen|a|to|in|an -2 kitchen|kuche|herd|cocina|cuisine"),
    ("DEGRADE", 1.0, "ADJ -4 CAST THEY|them|alle VERY* -1 PREP DET* DEVICE"), ("DEGRADE", 1.0, "encerrarlos|quemarlos|matarlos|echarlos|gasearlos -3 DEVICE|todos"), ("DEGRADE", 1.0, "les CAST|KILL dans|tous -2 DEVICE"), ("DEGRADE", 1.0, "GROUP -3 rien|nichts|nothing|nada a? zu? -1 faire|suchen|verloren|pintan|hacer"), ("DEGRADE", 1.0, "GROUP -3 born|nacen|geboren|nes -1 ADJ|MILD|criminals"), ("DEGRADE", 1.0, "there BE|are too many GROUP"), ("DEGRADE", 1.0, "too many|viele GROUP"),
    # sexual content and advances
    ("SEXUAL", 1.0, "spread|open Y legs|thighs|knees"), ("SEXUAL", 1.0, "abre|abreme las piernas"), ("SEXUAL", 1.0, "ecarte les jambes|cuisses"), ("SEXUAL", 1.0, "mach die beine breit"), ("SEXUAL", 1.0, "make love -1 to|with"), ("SEXUAL", 1.0, "get|come in|into|to my|mein|mi|mon bed|bett|cama|lit|pants"), ("SEXUAL", 1.0, "en|in|dans my|mein|mi|mon cama|bett|lit"), ("SEXUAL", 1.0, "sit|sitz on|auf my|mein lap|schoss"), ("SEXUAL", 1.0, "touch|kiss|blow|lick me -2 there|slowly|baby|hard|again"), ("SEXUAL", 1.0, "blow me"), ("SEXUAL", 1.0, "strip for me"), ("SEXUAL", 1.0, "do dirty|naughty things"), ("SEXUAL", 1.0, "que buena estas"), ("SEXUAL", 1.0, "t es bonne"), ("SEXUAL", 1.0, "hazme -1 LEWD|correr"), ("SEXUAL", 1.0, "suck|lick -1 his|her|my|your -2 LEWD|PRIVATE"), ("SEXUAL", 1.0, "sucked|licked him|her|it"), ("SEXUAL", 1.0, "lutsch|lutschen -2 LEWD|Y|HIS"), ("SEXUAL", 1.0, "an|zwischen|auf deine|deinen|deinem|ihre|ihren LEWD"), ("SEXUAL", 1.0, "rubbed|rubbing -2 against his|her PRIVATE|LEWD|ass|crotch"), ("SEXUAL", 1.0, "DESIRE -2 LEWD"), ("SEXUAL", 1.0, "DESIRE -3 SEXV"), ("SEXUAL", 1.0, "te voy a SEXV"), ("SEXUAL", 1.0, "vais te SEXV"),
    ("SEXUAL", 1.0, "lick|kiss|leck|besa|lame my|meine|mis|mes boots|feet|shoes|fusse|stiefel|pies|botas|pieds"), ("SEXUAL", 1.0, "in|around|on|um|en my|mein|mi|mon|ma LEWD"), ("SEXUAL", 1.0, "undress|undressed|stripped|fondled|groped|caressed|fingered her|him|sie"), ("SEXUAL", 1.0, "those|these|deine|tus|tes ADJ* tits|boobs|nipples|titten|tetas|nichons|seins"), ("SEXUAL", 1.0, "blas|lutsch|mamame|suce mir|moi|la"), ("SEXUAL", 1.0, "NAKED -4 MOAN"),
    ("SEXUAL", 1.0, "came|cum|kam inside her|him|me|you"), ("SEXUAL", 0.9, "riding|rode|mounted him|her"), ("SEXUAL", 1.0, "jerk|jerking|wank|wanking|jerked off|over"), ("SEXUAL", 1.0, "DESIRE -2 with|mit|contigo|avec Y? sleep|schlafen|dormir|acostarme|coucher"), ("SEXUAL", 1.0, "que|quel|what|menudo DET? -1 tits|ass|boobs|titten|arsch|tetas|culo|nichons|cul"), ("SEXUAL", 1.0, "envie de toi|te"), ("SEXUAL", 1.0, "deshabille|desnudate|undress|strip toi|te|yourself"), ("SEXUAL", 1.0, "DESIRE -2 SEXYOU"), ("SEXUAL", 1.0, "gustaria|apetece|ganas -2 SEXV|SEXYOU"),
    ("SEXUAL", 1.0, "DESIRE -4 SEXV -2 Y|HIS|ONE|ME"), ("SEXUAL", 1.0, "DESIRE -4 Y -5 SEXV"), ("SEXUAL", 1.0, "SEXV -1 Y|HIS|ONE|ME"), ("SEXUAL", 1.0, "Y SEXV"), ("SEXUAL", 1.0, "DESIRE -3 TOUCH -1 Y -3 NAKED|LEWD|PRIVATE|INSIDE|all|over|everywhere|uberall|toda|partout"), ("SEXUAL", 1.0, "DESIRE -2 TOUCH -2 HISBODY"), ("SEXUAL", 1.0, "DESIRE -2 Y -4 TOUCH|NAKED"), ("SEXUAL", 1.0, "DESIRE -2 STRIP|undress|desnudarte|desnudarla|deshabiller|lick|kiss|spank|ausziehen|taste|grope Y|ONE|all?"), ("SEXUAL", 1.0, "desnudarte|follarte|lamerte|chuparte|cogerte|besarte|tocarte|metertela"),
    ("SEXUAL", 1.0, "feel|have|spuren|sentir|sentirte|tener|avoir Y -1 INSIDE ME?"), ("SEXUAL", 1.0, "take|nehmen|tomar|prendre Y -1 from? von? por? par? BEHIND"), ("SEXUAL", 1.0, "Y -1 from|von|por|par BEHIND"), ("SEXUAL", 1.0, "touch|touches|play|playing Y? yourself|herself"), ("SEXUAL", 1.0, "TOUCH -2 HIS|Y -2 LEWD"), ("SEXUAL", 1.0, "TOUCH Y|HIS -1 NAKED|bare LEWD"), ("SEXUAL", 1.0, "TOUCH Y NAKED"), ("SEXUAL", 1.0, "STRIP|zieh dich|te|off -1 aus|NAKED"), ("SEXUAL", 1.0, "SEND -1 ME? -2 PIC -3 NAKED|LEWD|HISBODY"), ("SEXUAL", 1.0, "SEND -1 ME? -2 PIC -3 WITHOUT -2 CLOTHES|Y|anything"), ("SEXUAL", 1.0, "screw|screwed|bang|banged|poppen Y|her|him"), ("SEXUAL", 1.0, "TOUCH|slid|put HIS|Y|ONE|ihr POS_UNDER DET* CLOTHES|PRIVATE"), ("SEXUAL", 1.0, "ensename|muestrame|mandame|montre el|la|tu|tus|las|le|les|tes|moi -1 LEWD"), ("SEXUAL", 1.0, "SEND -2 NAKED|NUDES"), ("SEXUAL", 1.0, "take|takes off Y clothes|panties|bra|underwear|everything"), ("SEXUAL", 1.0, "TOUCH -1 la|el|las|los|le|les|die|den|das ADJ? LEWD"), ("SEXUAL", 1.0, "SEND -1 ME HISBODY"), ("SEXUAL", 1.0, "SEND|PIC nudes|nude|desnuda|desnudo|nackt|nue|nu"),
    ("SEXUAL", 1.0, "I -3 HORNY"), ("SEXUAL", 1.0, "horny|cachondo|cachonda|bandant -3 Y|for|when|wenn|cuando|quand"), ("SEXUAL", 1.0, "GOOD -1 on Y KNEES"), ("SEXUAL", 1.0, "on|auf|de|a Y? die? KNEES -4 MOUTH|suck|lick|beg|SEXV"), ("SEXUAL", 1.0, "wear|wearing|wears|trag|lleva|porte WITHOUT -2 POS_UNDER"), ("SEXUAL", 1.0, "meet me -6 INTEND? -3 TOUCH|SEXV|see"), ("SEXUAL", 1.0, "hand|hands|hande|mano|manos|main|mains|finger|fingers -1 POS_UNDER -1 HIS|Y|la|den|die|el|ses|sa -1 CLOTHES|PRIVATE|LEWD"), ("SEXUAL", 1.0, "POS_UNDER HIS|Y|den|las|les|ses|tes PRIVATE"), ("SEXUAL", 1.0, "wet|nass|mojada|mouillee and|y|et|und -1 HORNY|open|ready|begging"),
    ("SEXUAL", 1.0, "MOAN -10 came|LEWD|PRIVATE|SEXV|heard"), ("SEXUAL", 1.0, "PRIVATE|CLOTHES -4 MOAN"), ("SEXUAL", 0.8, "ONE|HIS MOAN"), ("SEXUAL", 1.0, "came|come|cum|kam|corrio|jouir|ejaculated -1 over|on|in|inside|sur|sobre|auf HISBODY"), ("SEXUAL", 1.0, "SEE -1 POS_UNDER|at|down|up|en|a|sur|auf|le|les HISBODY"), ("SEXUAL", 1.0, "SEE -4 POS_UNDER -1 CLOTHES -4 LEWD|NAKED"), ("SEXUAL", 1.0, "SEE -2 POS_UNDER HIS|Y CLOTHES"), ("SEXUAL", 1.0, "GOOD LEWD"), ("SEXUAL", 0.7, "nice|great|big|huge|sexy -1 tits|ass|boobs|breasts|titten|arsch|tetas|culo|nichons|cul|seins"), ("SEXUAL", 1.0, "tonight|later|it -2 in|im|en|au BED"), ("SEXUAL", 0.6, "nipples and"),
    ("SEXUAL", 1.0, "hard|steif|dur|duro in HIS CLOTHES"), ("SEXUAL", 1.0, "he|she|er|sie|I unzipped"), ("SEXUAL", 1.0, "open HIS|Y mouth"), ("SEXUAL", 1.0, "bent|bend|bending -3 over -6 SEXV|NAKED|LEWD|hard"), ("SEXUAL", 1.0, "HIS|Y|my|meine|mi|mon|ma LEWD -4 SEXV|TOUCH|in|inside|rein|dentro|dedans"), ("SEXUAL", 1.0, "Y -1 LEWD BE|look|looks|sind|estan"), ("SEXUAL", 1.0, "Y -1 VERY* GOOD? LEWD"), ("SEXUAL", 1.0, "sit|setz|sientate|assieds on|auf|en|sur my|mein|mi|mon face|dick|cock|gesicht|lap|cara|polla|schoss|queue"), ("SEXUAL", 1.0, "sleep|schlaf|schlafen|acuestate|acostarte|couche|coucher with|mit|conmigo|avec ME"), ("SEXUAL", 1.0, "have|had|haben|tener|faire sex|anal|sexo -2 with|mit|conmigo|con|avec"),
    ("SEXUAL", 1.0, "blow|hand job|jobs"), ("SEXUAL", 1.0, "blowjob|handjob|gangbang|cumshot|dildo|deepthroat|masturbate|masturbating|orgasm"), ("SEXUAL", 1.0, "suck|lick|chupa|lutsch|suce|leche my|mein|meinen|mi|ma|mon|HIS|me LEWD|la"), ("SEXUAL", 1.0, "mano|hand POS_UNDER la|den -1 CLOTHES|PRIVATE"), ("SEXUAL", 1.0, "NAKED -4 SEXV"), ("SEXUAL", 1.0, "Y NAKED"),
]

#: Context: the factor a match keeps when the words read stand around it in its clause.
CONTEXT = [
    ("KEEP", 0.25, "REPORT -12 REPORT"), ("KEEP", 0.25, "REPORT REPORT"), ("KEEP", 0.25, "call|calling|called|say|saying|words|nennen|llamar|traiter -14 REPORT|misconduct|forbidden|wrong"), ("KEEP", 0.25, "NOBODY|NEG may|should|must|darf|soll|puede|debe|doit|peut -1 call|say|nennen|llamar|traiter"), ("KEEP", 0.25, "insults|words|slurs|beleidigungen|insultos|insultes -2 such|like|wie|como|comme"),
]
#: Kinds of match that a negation directly before them denies ("never kill yourself", "do not touch her hips").
DENIED = ("THREAT", "ILLWISH", "SEXUAL")
#: Weight that matches of one kind add up to at most.
MOST = 2.0

_SPLIT = re.compile(r"[.!?;:…]+(?=\s|$)|\n+")
#: Ends of a line after which, and starts before which, a sentence does not go on: list items, time stamps, ``name:``.
_ENDS = re.compile(r"[.!?;:…][\"'”’»)\]]*$")
_STARTS = re.compile(r"[^\w\s\"'“‘«„¿¡(@$]|\(?(?:\d{1,3}|[a-z])[.)](?:\s|$)|[\[(]?\d{1,4}[:-]\d\d|[^\W\d_][\w'.-]*(?: [\w'.-]+)?:(?:\s|$)")
#: Letters set apart by one kind of mark or by blanks.
_APART = re.compile(r"(?<![^\W_])[^\W_](?:([-_.·* ]{1,2})[^\W_])(?:\1[^\W_]){2,}(?![^\W_])")
_TOKEN = re.compile(r"[^\W_]+(?:[*@$#%+!]+[^\W_]+)*[@$]?|[@$][^\W_]+")
_LEET = str.maketrans("013457@$!+", "oieastasit")
_LEET_L = str.maketrans("013457@$!+", "oleastasit")
_MASK = re.compile(r"[*@$#%+!0-9]")
_HEAD = re.compile(r"\b(c|d|j|l|m|n|s|t|qu|jusqu|puisqu|lorsqu)['’]")
_TAIL = re.compile(r"(?:(?<=\by[o0]u)|(?<=\bthey)|(?<=\bwe)|(?<=\bi)|(?<=\bhe)|(?<=\bshe)|(?<=\bwho)|(?<=\bthat)|(?<=\bit)|(?<=\bthere))['’](re|ll|m|ve|s|d)\b")
_JOINED = re.compile(r"['’]")
_REPEAT = re.compile(r"(.)\1+")


def rejoined(text: str) -> str:
    """Sentences that are wrapped over several lines on one line each."""
    out, last = [], ""
    for line in text.split("\n"):
        line = line.strip()
        goes_on = last and line and not _ENDS.search(last[-8:]) and not _STARTS.match(line)
        out.append((" " if goes_on else "\n") + line)
        last = line
    return "".join(out)


def apart(clause: str) -> str:
    """Shortened words written out by an apostrophe as words of their own."""
    if "'" not in clause and "’" not in clause:
        return clause
    return _JOINED.sub("", _TAIL.sub(r" \1", _HEAD.sub(r"\1 ", clause)))


class Grammar:
    """The composed stages; reading a clause gives the weight of its matches."""

    def __init__(self) -> None:
        self.symbols = Symbols()
        words: dict[str, int] = defaultdict(int)
        for w, s in lexicon.words():
            words[w] |= self.symbols[s]
        self.phrases = Transducer(self.symbols, PHRASES)
        self.clauses = Transducer(self.symbols, CLAUSES)
        self.context = Transducer(self.symbols, CONTEXT, blocks="NONE")
        written = {out for out, _, _ in [*PHRASES, *CLAUSES, *CONTEXT]}
        for _, _, text in [*PHRASES, *CLAUSES, *CONTEXT]:  # words that a rule names itself
            for part in text.split():
                for w in part.rstrip("?*+").split("|"):
                    if w.islower():
                        words[w] |= self.symbols[w]
        self.known = dict(words)
        self.severe = self.symbols.mask("INS|MILD|SLUR|GRP|DEHUM|SEXV|LEWD|NAKED|HORNY|ADJ|EXPL|KILL")
        self.denies = self.symbols["NEG"]
        self.denied = self.symbols.mask("|".join(DENIED))
        self.kinds = sorted({k for k, _, _ in CLAUSES})
        assert not written & set(lexicon.FIXED)
        self.squeezed: dict[str, str] = {}
        self.near: dict[str, list[str]] = defaultdict(list)
        self.by_shape: dict[tuple[str, int], list[str]] = defaultdict(list)
        for w in sorted(self.known):
            if self.known[w] & self.severe:
                if len(w) >= 4:
                    self.squeezed.setdefault(_REPEAT.sub(r"\1", w), w)
                if len(w) >= 3:
                    self.by_shape[w[0], len(w)].append(w)
                if len(w) >= 7:
                    for d in {w, *drops(w)}:
                        self.near[d].append(w)
        self.memo: dict[str, int] = {}
        self.hopes: dict[int, bool] = {}

    def read(self, token: str) -> int:
        """Symbols of a token, through figures, masks, repeated letters or a slip; 0 for other words."""
        found = self.memo.get(token)
        if found is None:
            found = self.known.get(token)
            if found is None:
                w = self._undisguise(token) if len(token) > 2 else None
                found = self.known[w] if w else 0
            if len(self.memo) < 300_000:
                self.memo[token] = found
        return found

    def _undisguise(self, token: str) -> str | None:
        plain = token
        if _MASK.search(token) and not token.isdigit():
            for table in (_LEET, _LEET_L):
                plain = token.translate(table)
                if plain in self.known:
                    return plain
                if (s := _REPEAT.sub(r"\1", plain)) in self.squeezed:
                    return self.squeezed[s]
            shown = [(i, c) for i, c in enumerate(token) if not _MASK.match(c)]
            if len(shown) >= 2 and not _MASK.match(token[0]):
                fits = [w for w in self.by_shape.get((token[0], len(token)), ()) if all(w[i] == c for i, c in shown)]
                if fits:
                    return min(fits, key=lambda w: (-(self.known[w] & self.severe).bit_count(), w))
        if (s := _REPEAT.sub(r"\1", plain)) in self.squeezed and len(s) >= 4 and s != plain:
            return self.squeezed[s]
        if 6 <= len(plain) < 30:
            close = {w for d in {plain, *drops(plain)} for w in self.near.get(d, ()) if w[0] == plain[0] and one_slip(plain, w)}
            if close:
                return min(close)
        return None

    def hopeful(self, present: int) -> bool:
        """Whether any clause could be matched where these symbols are present, in whatever order."""
        found = self.hopes.get(present)
        if found is None:
            written = present
            for r in self.phrases.candidates(present):
                written |= r.out_mask
            found = bool(self.clauses.candidates(written))
            if len(self.hopes) < 100_000:
                self.hopes[present] = found
        return found

    def clause(self, tokens: list[str]) -> float:
        """Weight of the matches of a clause, after its context is taken into account."""
        memo, masks, present = self.memo, [], 0
        for t in tokens:
            m = memo.get(t)
            if m is None:
                m = self.read(t)
            masks.append(m)
            present |= m
        if not self.hopeful(present):
            return 0.0
        lattice = [[(i + 1, m, 0.0)] for i, m in enumerate(masks)]
        present = self.phrases.write(lattice, present)
        best: dict[str, tuple[str, float]] = {}
        for rule, start, _, weight in self.clauses.matches(lattice, present):
            if rule.out_mask & self.denied and any(m & self.denies for m in masks[max(0, start - 2):start]):
                continue
            if weight > best.get(rule.text, ("", 0.0))[1]:
                best[rule.text] = rule.out, weight
        if not best:
            return 0.0
        total = sum(min(MOST, sum(w for k, w in best.values() if k == kind)) for kind in self.kinds)
        return total * min([1.0, *(r.weight for r, _, _, _ in self.context.matches(lattice, present))])

    def explain(self, text: str) -> list[tuple[str, str, float]]:
        """Kind, rule and weight of every match of a text's clauses, before the context."""
        out = []
        for tokens in self.sentences(text):
            lattice = [[(i + 1, self.read(t), 0.0)] for i, t in enumerate(tokens)]
            present = 0
            for at in lattice:
                present |= at[0][1]
            present = self.phrases.write(lattice, present)
            out += [(r.out, r.text, w) for r, _, _, w in self.clauses.matches(lattice, present)]
        return out

    @staticmethod
    def sentences(text: str) -> Iterator[list[str]]:
        """Words of every clause of a text."""
        plain = fold(unmarked(text))
        plain = _APART.sub(lambda m: re.sub(r"[^\w]|_", "", m.group(0)), plain)
        for part in _SPLIT.split(rejoined(plain)):
            if part and (tokens := _TOKEN.findall(apart(part))):
                yield tokens

    def score(self, text: str | None) -> tuple[float, int]:
        """Highest clause score of a text and the number of its clauses that are cases by themselves."""
        if not text:
            return 0.0, 0
        best, cases = 0.0, 0
        for tokens in self.sentences(text):
            s = self.clause(tokens)
            best = max(best, s)
            cases += s >= CASE
        return best, cases


_GRAMMAR: list[Grammar] = []


def grammar() -> Grammar:
    """The grammar, built once in a process."""
    if not _GRAMMAR:
        _GRAMMAR.append(Grammar())
    return _GRAMMAR[0]


def with_abuse_score(df: DataFrame, text: str, score: str = "abuse_score", cases: str = "abusive_clauses") -> DataFrame:
    """Adds the score of ``text`` and its number of abusive clauses; 0 for null and empty texts.

    Whole texts are read, clause by clause; every row is scored, and nothing is shuffled.
    """

    @F.pandas_udf("struct<score double, cases int>")
    def rate(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        g = grammar()
        for t in texts:
            yield pd.DataFrame([g.score(x) for x in t], columns=["score", "cases"]).astype({"score": "float64", "cases": "int32"})

    return spread(df).withColumn("__r", rate.asNondeterministic()(F.col(text))).withColumn(score, F.col("__r.score")).withColumn(cases, F.col("__r.cases")).drop("__r")
