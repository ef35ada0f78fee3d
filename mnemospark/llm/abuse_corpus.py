"""A general lexicon of abusive wording in four languages, on which the abusive dictionary starts.

Written from general knowledge of the languages and not from any table; what is abusive in a
collection at hand comes from its reviewed documents (``abuse.score_abuse``). Frames are filled
by rule. Fixed values.
"""

from __future__ import annotations

#: Insults and coarse words.
WORDS = {
    "en": "idiot moron imbecile cretin bastard bitch whore slut asshole arsehole cunt fucker motherfucker dickhead prick wanker twat retard scum scumbag vermin filth swine faggot cocksucker shithead douchebag jackass degenerate parasite subhuman dumbass bullshit tosser nutjob pervert rapist".split(),
    "de": "Idiot Vollidiot Arschloch Schlampe Hure Nutte Wichser Fotze Hurensohn Missgeburt Schwuchtel Drecksau Scheißkerl Mistkerl Spasti Abschaum Ungeziefer Untermensch Dummkopf Trottel Schweinehund Miststück Pisser Kanake Penner Saftsack Vollpfosten".split(),
    "fr": "connard connasse salope salaud pute putain enculé bâtard ordure abruti crétin débile imbécile merde pédé tapette pouffiasse trouduc racaille vermine sous-homme bougnoule couille branleur grognasse pourriture".split(),
    "es": "gilipollas cabrón puta puto zorra maricón imbécil idiota subnormal mierda escoria basura desgraciado malparido pendejo capullo hijoputa cerdo asqueroso bastardo tarado mamón sudaca guarra lameculos infrahumano".split(),
}

#: Groups of people, to be put into ``CONTEMPT``.
GROUPS = {
    "en": ["those people", "the migrants", "the Jews", "the Muslims", "the blacks", "women", "gays"],
    "de": ["diese Leute", "die Migranten", "die Juden", "die Moslems", "die Schwarzen", "Frauen", "Schwule"],
    "fr": ["ces gens-là", "les migrants", "les juifs", "les musulmans", "les noirs", "les femmes", "les gays"],
    "es": ["esa gente", "los migrantes", "los judíos", "los musulmanes", "los negros", "las mujeres", "los gays"],
}

CONTEMPT = {
    "en": ["{0} are a disease", "{0} should all be killed", "{0} do not deserve to live", "i hate {0}, they are worthless", "get rid of {0} once and for all", "{0} are inferior to us"],
    "de": ["{0} sind eine Seuche", "{0} gehören alle umgebracht", "{0} verdienen es nicht zu leben", "ich hasse {0}, sie sind wertlos", "{0} muss man loswerden", "{0} sind minderwertig"],
    "fr": ["{0} sont une maladie", "il faut tuer {0}", "{0} ne méritent pas de vivre", "je hais {0}, ils ne valent rien", "il faut se débarrasser de {0}", "{0} sont inférieurs"],
    "es": ["{0} son una enfermedad", "hay que matar a {0}", "{0} no merecen vivir", "odio a {0}, no valen nada", "hay que deshacerse de {0}", "{0} son inferiores"],
}

#: Threats, wishes of death and explicit descriptions.
PHRASES = {
    "en": ["i am going to kill you", "you deserve to die", "i hope you get cancer", "i will break every bone in your body", "you will pay for this with your life", "burn in hell", "kill yourself", "i will rape you", "shoot them all", "we know where you live", "shut the fuck up", "go fuck yourself", "suck my dick", "she gave him head", "his hard cock", "her naked breasts", "he fucked her hard", "she moaned as he entered her", "wet pussy", "big tits", "jerk off", "cum in her mouth"],
    "de": ["ich werde dich umbringen", "du verdienst den Tod", "ich hoffe du stirbst", "ich breche dir alle Knochen", "das wirst du mit dem Leben bezahlen", "häng dich auf", "bring dich um", "wir wissen wo du wohnst", "halt die Fresse", "fick dich", "leck mich am Arsch", "sein harter Schwanz", "ihre nackten Brüste", "er fickte sie hart", "sie stöhnte als er in sie eindrang", "dicke Titten", "einen runterholen", "in den Mund spritzen"],
    "fr": ["je vais te tuer", "tu mérites de mourir", "j'espère que tu vas mourir", "je vais te casser la gueule", "tu vas le payer de ta vie", "va crever", "suicide-toi", "on sait où tu habites", "ferme ta gueule", "va te faire foutre", "nique ta mère", "suce-moi la queue", "sa queue dure", "ses seins nus", "il la baisait violemment", "elle gémissait quand il la pénétra", "gros nichons", "se branler"],
    "es": ["voy a matarte", "mereces la muerte", "espero que te mueras", "te voy a romper los huesos", "lo pagarás con tu vida", "púdrete en el infierno", "suicídate", "sabemos dónde vives", "cierra el pico", "que te jodan", "vete a la mierda", "chúpame la polla", "su polla dura", "sus pechos desnudos", "se la follaba con fuerza", "ella gemía cuando la penetró", "tetas grandes", "hacerse una paja"],
}


def abusive() -> list[str]:
    """Every word, phrase and filled frame."""
    out = [w for words in WORDS.values() for w in words]
    out += [x for phrases in PHRASES.values() for x in phrases]
    return out + [f.format(g) for lang, frames in CONTEMPT.items() for f in frames for g in GROUPS[lang]]
