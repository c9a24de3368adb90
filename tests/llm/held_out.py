"""Sentences written by hand after the grammar was finished; it was not changed for them."""

HARMFUL = """
You're a gutless snake and a liar.
That idiot of a foreman ruined it.
Nobody on this shift can stand you, you smug bastard.
Crawl under a rock, you slimy toad.
You have the IQ of a doorknob.
I could strangle you with my bare hands.
Come near me again and I'll smash your kneecaps.
Somebody will find you in a ditch.
I hope your kids get cancer.
Just hang yourself already.
Indians stink.
The disabled are a burden and ought to be put down.
We don't want Muslims in this plant.
All Poles steal.
I dream of licking your thighs.
Her boobs bounced while he took her from behind.
Wanna see my cock?
Come to my place and I'll make you moan.
Du bist eine faule Sau.
Du hirnloser Affe!
Ich schlag dir den Schädel ein.
Verrecke, du Hund.
Zigeuner klauen alle.
Frauen sind zu blöd dafür.
Ich will deine Brüste küssen.
Zieh dein Hemd aus, Süße.
Eres un cerdo asqueroso.
Cállate, imbécil.
Te voy a cortar el cuello.
Ojalá te pudras.
Las gitanas son unas ladronas.
Quiero verte desnuda.
Tu n'es qu'une larve.
Pauvre débile, va.
Je vais t'égorger.
Les gays sont des malades.
Je veux te caresser les fesses.
""".strip().split("\n")

HARMLESS = """
The snake camera is stuck in the pipe.
Toad green is the colour of the new bins.
You have the keys of the store room.
The strangler of the carburettor is dirty.
Come near the camera and show the part again.
Kneecaps of the mannequin are sold apart.
Indians in the Pune plant start at six.
The disabled toilet is on the first floor.
Poles steel the edges by hand.
The bucket stinks of old coolant.
We lick the envelope flap with a sponge.
Her boots were wet, so she took the lift.
You are two minutes early.
He was killed by a falling crane in 1950.
Die faule Stelle im Holz muss weg.
Der Hund bellt an der Pforte.
Frauen und Männer bekommen gleichen Lohn.
Zieh dein Hemd in die Hose, es hängt in die Maschine.
Der Affe des Films ist aus Plüsch.
El cerdo asado sale a las doce.
Corta el cuello de la camisa y cóselo.
Las gitanas del baile vienen el viernes.
Cállate no es una opción del menú.
La larve du moule est en cire.
Les gays de l'équipe organisent une fête.
Caresser le tissu pour trouver le défaut.
""".strip().split("\n")
