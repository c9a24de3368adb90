"""Sentences written by hand that the grammar was developed on: harmful ones and harmless ones."""

HARMFUL = """
Kill yourself.
I will rape you tonight.
All Muslims must be exterminated.
I'm going to murder your whole family.
Ich bringe dich um.
Women are too stupid to run a lathe.
Send nudes.
Those people are subhuman.
You disgusting fat cow, nobody likes you.
Fuck you!
You are such a pathetic loser.
Nobody likes you, you fat ugly cow.
Go kill yourself.
I know where you live and I will burn your house down.
I'll break every bone in your body.
Shut the fuck up, you stupid bitch.
You people are nothing but filthy animals.
Immigrants are parasites that infest our cities.
Gas the Jews.
All gays should be shot.
Muslims are terrorists and should be deported.
Women belong in the kitchen, not on the shop floor.
Blacks are lazy and stupid.
We should get rid of all foreigners.
Go back to your own country.
I want to lick your pussy.
Show me your tits.
She sucked his cock behind the warehouse.
I can't stop thinking about your ass.
Come sit on my face tonight.
He grabbed her breasts and started kissing her neck.
Suck my dick.
I hope you die of cancer.
Someone should put a bullet in your head.
You deserve to be beaten.
The world would be better off without you.
You are a waste of oxygen.
You're dumber than a rock.
Fucking retard.
What a bunch of morons.
He is a complete idiot.
That faggot should be fired.
Drop dead, you miserable worm.
I will find you and make you suffer.
Watch your back, we are coming for you.
If you come back here I will smash your skull.
Du dumme Sau, halt endlich die Klappe.
Du bist so ein hässliches Stück Scheiße.
Ich schlage dir die Zähne aus.
Ich mach dich kalt.
Fick dich!
Verpiss dich, du Hurensohn.
Ausländer raus!
Die Juden sind eine Plage.
Schwule sind krank und gehören weggesperrt.
Frauen haben hier nichts zu suchen.
Zeig mir deine Titten.
Ich will dich ficken.
Ich will deinen Arsch anfassen.
Hoffentlich verreckst du.
Er griff ihr unter den Rock.
Wer das gebaut hat, ist ein Vollidiot.
Eres un pedazo de mierda.
Te voy a matar, hijo de puta.
Te voy a romper la cara.
Vete a la mierda, imbécil.
Los moros son unos ladrones.
Las mujeres no sirven para nada.
Fuera los inmigrantes de este país.
Ojalá te mueras.
Quiero chuparte las tetas.
Enséñame el culo.
Qué ganas tengo de follarte.
Cállate, puta.
Eres más tonto que una piedra.
Los gitanos son escoria.
Ferme ta gueule, connard.
Je vais te tuer.
Je vais te casser la gueule.
Va te faire foutre.
Les arabes sont des parasites.
Les juifs contrôlent tout, il faut les exterminer.
Retourne dans ton pays.
Montre-moi tes seins.
J'ai envie de te baiser.
Il glissa sa main sous sa jupe.
Tu es une grosse vache inutile.
J'espère que tu vas crever.
Espèce de salope.
Les femmes sont trop bêtes pour ce travail.
What an id1ot you are.
You f u c k i n g moron.
You're all a bunch of b@stards.
k1ll y0urself
You absolute waste of space.
Nobody wants you here, you disgusting freak.
He's a lying sack of shit.
My supervisor is a fucking asshole.
You brainless monkeys can't do anything right.
Shut your filthy mouth, bitch.
Your mother is a whore.
I'm gonna stab you in the parking lot.
One more word and I will knock your teeth out.
We will hunt you down and kill you.
You won't leave this building alive.
I hope you choke on your lunch.
Do everyone a favour and hang yourself.
You should be shot.
Jews are rats.
Those filthy immigrants steal our jobs.
Africans are savages.
Send all refugees back where they came from.
Disabled people are useless, they should be put down.
No gays allowed in this workshop.
Trans people are disgusting freaks.
I want to see you naked in the locker room.
Take off your clothes and get on your knees.
He stuck his hand up her skirt.
She moaned while he licked her nipples.
Your ass looks so hot in those jeans.
Wanna have sex with me after work?
I would love to bend you over this table.
You are a f*cking 1diot.
What a b!tch.
Du bist dumm wie Brot.
Du widerliches Dreckschwein.
Halt dein Maul, du Spast.
Ich stech dich ab.
Ich brech dir alle Knochen.
Geh sterben.
Kanaken raus aus Deutschland.
Flüchtlinge sind Schmarotzer.
Behinderte sollte man vergasen.
Schick mir Nacktbilder.
Ich will dich nackt sehen.
Er fasste ihr an die Brüste.
Eres una zorra asquerosa.
Eres un inútil de mierda.
Te voy a partir las piernas.
Que te jodan, cabrón.
Muérete ya.
Los inmigrantes son basura.
Los maricones deberían morir.
Quiero lamerte todo el cuerpo.
Mándame una foto desnuda.
Le tocó las tetas en el vestuario.
Tu es vraiment une merde.
Sale connard, dégage.
Je vais te crever.
On va te péter les dents.
Crève, salope.
Les noirs sont des singes.
Dehors les étrangers.
Les pédés méritent la mort.
Je veux te lécher partout.
Envoie-moi des photos de tes seins.
You are the dumbest person I have ever met.
What a useless piece of garbage you are.
Everybody hates you, you creepy loser.
You smelly old hag, go back to your cave.
Only a total cretin could have signed this.
Screw you and your whole family.
I swear I will cut your throat.
You will regret this, I know where your kids go to school.
I'm going to smash your ugly face in.
Next time I see you I will put you in a grave.
I hope your house burns down with you in it.
Please drop dead.
Someone ought to strangle you.
Gypsies are thieves.
Homosexuals are a disease and must be wiped out.
Those people breed like rabbits.
Women are inferior and should obey.
We do not want blacks here.
Muslims out!
Cripples do not belong in a factory.
I want you naked on my desk.
Let me feel your breasts.
He came inside her.
She was riding him on the pallet.
I jerk off thinking of you.
Nice ass, sweetheart, come here and let me spank it.
You stoopid m0r0n.
Eat shit, you worthless slut.
Du bist das Letzte, du Abschaum.
Ihr seid alle hirnlose Vollidioten.
Leck mich am Arsch, du Wichser.
Ich haue dir gleich in die Fresse.
Ich werde dich umbringen.
Hoffentlich stirbst du bald.
Die Türken sind Ungeziefer.
Juden gehören ins Gas.
Deine Titten sind geil.
Ich will mit dir schlafen.
Er küsste ihre nackten Brüste.
Eres la persona más estúpida del mundo.
Cierra el pico, gilipollas.
Te voy a arrancar la cabeza.
Voy a matarte.
Espero que te mueras pronto.
Los negros son animales.
Hay que echar a todos los moros.
Me gustaría follarme a tu hermana.
Qué culo tienes.
T'es qu'un gros con.
Ta gueule, espèce d'abruti.
Je vais t'étrangler.
Je sais où tu habites.
Va crever.
Les juifs sont de la vermine.
Les migrants n'ont rien à faire chez nous.
J'ai envie de toi, déshabille-toi.
Elle gémissait pendant qu'il lui caressait les seins.
Suce ma bite.
You are a spineless little coward.
That guy is a total moron.
Get lost, you filthy rat.
Your brain is smaller than a pea.
My boss is a retarded pig.
I will shoot you in the head.
I'll rip your tongue out.
You better run or I will break your legs.
Let's burn his house with him inside.
I wish you were dead.
You ought to be hanged.
May you rot in hell.
Arabs are all terrorists.
We must cleanse this country of foreigners.
Lesbians are sick.
Never trust a gypsy, they all steal.
Lick my boots, slave.
I want your lips around my cock.
He undressed her slowly and caressed her thighs.
Those tits make me so hard.
You fat f.u.c.k.
Du bist eine wertlose Schlampe.
So ein verdammter Idiot!
Ich reiße dir den Kopf ab.
Du gehörst erschossen.
Schwarze sind dumm und faul.
Komm her und blas mir einen.
Sie zog sich nackt aus und stöhnte laut.
Vaya panda de imbéciles.
Eres feo y estúpido.
Te voy a quemar vivo.
Deberías estar muerto.
Los judíos son ratas.
Las mujeres son tontas.
Quiero besarte los pechos.
Le agarró el culo en el pasillo.
Tu es complètement débile.
Quel tas de merde, ce type.
Je vais lui casser les jambes.
Tu devrais te pendre.
Les roms sont des voleurs.
Les femmes à la cuisine.
Je veux voir tes seins.
Il lui a touché les fesses.
You are a disgusting pervert.
You lot are a bunch of clowns.
Are you retarded or what?
Nobody would miss you, you ugly troll.
I am going to strangle you with that cable.
We will break your knees if you talk.
I'll beat the crap out of you.
I hope a forklift crushes you.
Mexicans are lazy thieves.
Get these filthy foreigners out of my sight.
All trans people should be locked in a cage.
I'd love to fuck your wife.
Her nipples were hard and he sucked them.
Send me a picture of your boobs.
Spread your legs for me.
Du Arsch, verschwinde.
Was für ein Haufen Idioten.
Ich poliere dir die Fresse.
Dich sollte man erschießen.
Alle Schwulen gehören vergast.
Asylanten sind Abschaum.
Ich will an deinen Titten lutschen.
Menudo gilipollas estás hecho.
Eres una vergüenza, payaso asqueroso.
Os voy a matar a todos.
Ojalá te atropelle un camión.
Los gays son unos enfermos.
Quiero follarte encima de la mesa.
Quel connard, celui-là.
T'es vraiment trop conne.
Je vais te briser les genoux.
Les handicapés sont des parasites.
Viens, je vais te sucer.
""".strip().split("\n")

HARMLESS = """
Keep the pigs out of the furnace, they belong on the pallet.
The saw can cut your fingers if the guard is off.
Do not put your hand near the press, it will crush your fingers.
Women are at higher risk of cancer in this plant.
Put them all in the oven at 200 degrees.
Throw them all into the furnace, the castings are scrap.
What a damn tool, it broke again.
The robot will kill the process if you press the button.
Kill the daemon and restart your terminal.
I will cut your cable to length tomorrow.
He broke his finger in the press last year.
The hand press can crush a finger, keep your hands away.
Women make up 30 percent of the new hires.
Refugees who work here get language training.
The immigrants' association visited the plant.
We hired three migrants and two women last month.
The ugly paint job must be redone.
This stupid machine is broken again.
Your report is useless, please write it again.
The work is pathetic and the finish is terrible.
The dirty parts go into the wash booth.
Rats were found in the store, call pest control.
Strip the wire and screw the nut onto the bolt.
The nipple must be greased, then mount the cock valve.
Pump until the wet concrete is hard.
Insert the male plug into the female socket.
The breast drill hangs behind the bench.
I hope the press does not fall on your hand.
Do not touch your face with dirty gloves.
Never put your fingers between the rollers.
If you fall into the vat, call for help.
The guard keeps your hand out of the saw.
Calling a colleague an idiot is misconduct.
Sexual remarks and racist jokes are forbidden in this hall.
Anyone who threatens to kill a colleague will be reported to the office.
Please send me pictures of the broken casting.
Show me your hands so that the camera can see the gloves.
She bent over the bench to pick up a screw.
He put his hand under the table to find the switch.
The worker lifts her arm and looks down at the panel.
Turn the head of the screw until it stops.
The foreign supplier sent dirty parts.
Throw the old gloves in the furnace.
The dog clutch and the monkey wrench are missing.
Use the pig iron first and the donkey engine later.
I want to see you at the line at six.
I want you to take the box from behind the shelf.
You are wrong about the torque, check it again.
You are not stupid, the manual is just bad.
Where do you live? The bus leaves at six.
Do you know where you parked the forklift?
Der Hund läuft über das Band, die Sau ist eine Gussform.
Der nackte Draht darf die Hand nicht berühren.
Frauen und Männer haben getrennte Umkleiden.
Die Ausländer aus dem Kurs bekommen neue Ausweise.
Du bist heute spät dran.
Ich schlage dir einen neuen Termin vor.
Ich breche das Werkstück und lege die Teile auf die Bank.
Bitte nicht mit dem Finger in die Presse greifen.
Der faule Kompromiss hilft niemandem.
Das dumme Ding klemmt schon wieder.
La prensa puede cortar los dedos del operario.
Las mujeres del turno de noche piden una sala.
Los inmigrantes firmaron el contrato el lunes.
El perro de la nave duerme junto a la caja sucia.
Te voy a mandar las fotos de la pieza.
Eres el último en salir, cierra la puerta.
La mano izquierda sujeta la falda de goma.
La presse peut couper les doigts.
Les femmes de l'équipe ont reçu de nouveaux gants.
Les étrangers doivent montrer leur badge.
Tu es en retard, ferme la porte.
Je vais te montrer la machine.
Le chien de garde du programme redémarre la carte.
La vis est nue et sale, il faut la jeter.
Hang the coat on the hook and shut the door.
I will beat the panel flat before you come back.
We should remove the old people counter from the door.
The black ones go left, the yellow ones go right.
Keep the white ones out of the oven, they melt.
They are not for sale, and not for women's sizes only.
The old men's locker room is closed.
This lot is scrap, throw it out.
Those people at the gate are waiting for a badge.
Your fingers are cold, wear gloves.
The drill hit my finger, it hurts.
The child process was killed and the parent hangs.
A parasite current flows, kill the power.
The parasites in the coolant are a disease risk.
Migrants are people with rights.
Gay and lesbian colleagues are welcome here.
The dumb waiter is stuck between two floors.
Kill the power before you open the cabinet.
The suicide door of the van does not close.
Cut the tongue of the shoe along the line.
The gay pride flag hangs in the canteen.
Muslim colleagues asked for a prayer room.
Foreign workers are welcome to the language course.
The women's team beat the men's team at football.
The hammer fell and broke his toe.
My fingers hurt after the night shift.
If you touch the blade, it will cut you.
I will break the casting if I hit it harder.
This idiotic form asks for the same number twice.
The crappy label printer jams every hour.
Your handwriting is terrible, nobody can read it.
You were late and the lid is on wrong.
That was a stupid mistake, sorry about it.
Look at this ugly weld seam again.
Feed the worm gear with grease.
Hang the dog tags on the hook.
The rats' nest of cables behind the press must go.
The parasite load is below two watts.
Locusts were found in the grain sample.
We are going to strip the old paint from your bench.
I want to touch up the paint before you come.
Bend over the sheet and press it flat.
Take your gloves off and show me your hands.
The naked eye cannot see the crack.
Lay the shaft between the legs of the stand.
The hot chick peas went into the canteen pot.
Mount the cock on the pipe and open it slowly.
Bang the pin twice with the mallet.
Threats against colleagues are reported to the police.
Nobody may call a colleague a bitch or a whore, says the policy.
The training explains what harassment and hateful comments are.
The report quotes the words idiot and moron from the chat.
You people at the gate did a great job.
You are a lifesaver, thanks for the help.
You beat me to the coffee machine again.
I would kill for a coffee right now.
Du hast die Schraube falsch angezogen.
Die dumme Maschine steht schon wieder.
Der Affe auf dem Aufkleber hält eine Banane.
Schlag den Nagel ganz in das Brett.
Ich bringe dir morgen die Handschuhe.
Die Flüchtlinge im Kurs lernen schnell.
Die Brust der Puppe wird aus zwei Teilen geklebt.
Der Schwanz der Feile passt in das Heft.
La perra del vigilante duerme en la entrada.
Te voy a enseñar la máquina nueva.
Los extranjeros traen su permiso el lunes.
El tonto del programa borra la lista.
Corta la lengüeta y pega la suela.
La mujer del jefe trajo pan para todos.
Tu as oublié de fermer la vanne.
Les immigrés du cours parlent bien français.
Le singe sur le carton est le logo du client.
Je te casse le prix de moitié.
Il faut jeter la vieille colle dans la poubelle.
La bite d'amarrage du quai est rouillée.
The monkey wrench hit the floor.
Please kill the lights in hall two.
The dead man's switch works again.
Shoot the video from above, not from behind.
The execution of the plan begins on Monday.
A worm drive sits below the kiln.
Grease the breast beam of the loom.
The horny layer of the hoof is trimmed first.
The bitch box at gate three is broken.
The stripper pulls the insulation from the wire.
She is wet from the rain and cold.
Come over to my bench and touch the sample.
Your body weight must stay on both legs.
I saw your hands under the table in the video.
Put your fingers on the mark and press.
You will burn your fingers on this lid.
He will break his neck on that ladder if nobody fixes it.
It was dumb of me to skip the test.
That is the ugliest seam of the year.
This trash printer drives me mad.
I hate Mondays and this conveyor.
The Turkish supplier sent the yarn on time.
Blacks and whites of the picture are inverted.
The Poles of the magnet are marked red.
Old people need larger labels.
Women may not lift more than twenty kilos here.
Racist insults lead to dismissal.
Someone wrote a hateful comment about refugees and was suspended.
The word slut is on the list of forbidden words.
Do not threaten to hit a colleague.
Nobody was killed in the accident, but one man lost a finger.
The saw took off the tip of his thumb.
You are in clip nine, right behind the forklift.
You are hard to hear, speak up.
I will beat my record if you help.
We are going to crush the old cans.
I am going to cut you a new gasket.
Die Nutte gehört nicht in den Bericht, sagt die Regel.
Das faule Holz kommt in den Ofen.
Du musst die Katze aus der Halle jagen.
Ich steche dir ein Loch in den Gurt.
Deine Hand verdeckt die Kamera.
Die Frau hinten trägt einen Helm.
Die Ratte im Lager war schon tot.
Den nackten Fuß nie auf den Boden setzen.
Die Schlampe von Kabel hängt wieder herum.
El gato mató una rata en el almacén.
Te rompo el papel en dos trozos.
Tu mano tapa la lente otra vez.
La pieza es fea pero sirve.
Los chinos mandaron el molde nuevo.
Quiero tocar la pieza antes de pintarla.
Echa la basura al contenedor.
La cerda del cepillo está gastada.
Tu as cassé le manche du marteau.
Le chien du gardien aboie la nuit.
Les femmes du service ont leur vestiaire.
Je veux te montrer le nouveau four.
Cette machine est une vraie catastrophe.
La queue de la pièce est trop longue.
The cow bell on the gate is missing.
Slaughter of the old fixtures starts in May.
The hit list of the scanner has nine entries.
She killed it with that presentation.
This is the dumbest firmware I have seen.
Stick your badge on the coat, please.
We must clean this hall of old pallets.
The slave unit follows the master drive.
The ass end of the trailer hit the ramp.
Trim the fat edge and rub it with a wet cloth.
Her hands hold the plate while he looks down at the screen.
His leg was broken in the accident.
They will throw the mould into the furnace at noon.
The homeless shelter sent us their thanks.
African suppliers deliver the cocoa.
Nobody should cry over one broken lid.
You two are late, the truck left at five.
Hope you sleep well after the night shift.
You must wear gloves or you will lose a finger.
What a beautiful piece of work.
Die Ziege aus Holz ist fertig lackiert.
Das Gesicht der Figur ist schlecht gemalt.
Ich habe dir die Presse gezeigt.
Der Kopf der Schraube ist abgerissen.
Die Juden feiern heute ein Fest, die Kantine bleibt offen.
Du musst die Hose wechseln, sie ist nass.
Er hat sich den Arm gebrochen.
La rata del ordenador no tiene pilas.
Los viejos moldes están en el almacén.
Te mando la cara interior de la pieza.
El cerdo de plástico va en la caja azul.
La mujer lleva una falda azul.
La vache du logo est trop petite.
Le cul de la bouteille est fêlé.
Tes gants sont sales, change-les.
Les vieux fours sont à jeter.
Il a perdu un doigt dans la presse.
La tête de vis est cassée.
The pig was cast in sand and is still hot.
The dirty lens makes every clip useless.
You are using the wrong drill.
His knee hurts since he fell off the ladder.
I will send you a picture of the weld.
The Jewish museum ordered twenty display cases.
Spread the legs of the tripod.
He licked the stamp and closed the letter.
The hard hat must cover the whole head.
Kill two birds with one stone, clean and grease.
These idiots lights on the dashboard are out.
Foreigners need form seven for the gate.
Der Hahn am Kessel tropft.
Die alte Presse gehört auf den Schrott.
Du hast eine tolle Naht gemacht.
Der Bock trägt den schweren Kopf der Puppe.
La cabeza del tornillo está rota.
Eres muy rápido con la llave.
El mono de trabajo está sucio.
Los refugiados empiezan el curso hoy.
Tu es trop loin de la caméra.
La poule en bois est peinte en jaune.
Il faut couper le courant avant.
Les jambes de la table sont sales.
""".strip().split("\n")
