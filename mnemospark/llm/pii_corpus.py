"""Made-up sentences, with the personal information in them marked, to train on.

Numbers, streets and names are drawn at random from public formats; the carriers are plain
sentences in four languages, and for each kind there are sentences that hold something
alike which isn't personal.
"""

from __future__ import annotations

import random

#: Common given names.
GIVEN = (
    "Anna Maria Peter Paul John Mary James Robert Linda Michael Sarah David Laura Thomas Julia Daniel Emma Martin Sophie Andreas Claudia Stefan Petra Hans Ingrid "
    "Jean Marie Pierre Camille Louis Chloé Antoine Juliette Luis Carmen José Lucía Miguel Elena Carlos Rosa Omar Fatima Yusuf Aisha Chen Mei Hiroshi Yuki Ravi Priya "
    "Ivan Olga Piotr Agnieszka Lars Astrid Nils Freya Marco Giulia Kofi Amina Tariq Leila Noah Mia Ella Oscar Clara Felix Nora Simon Ruth Karl Greta Hugo Alice Ana Paweł Zeynep Ольга Иван Мария Сергей Ελένη Γιώργος"
).split()

_STARTS = "Bar Cas Dra Fen Gol Har Im Kel Lun Mar Nak Os Pet Quil Rok Sol Tor Ul Ver Wyn Zab Ach Bran Del Thorn Vint Gess Tal Or Eck".split()
_MIDDLES = "na ra le vi to mer ber go lo den sha ri ver ko ten der".split()
_ENDS = "son quist man ick holt by wick ova ski ard ley stein feld mann ez eau ier ini moor gate worth berg vik ström ton ert os".split()
_OTHER = "Łuczak Šimić Şahin Żak Čapek Ďurica Őri Šimek Łukasik Ångström Çelik Žižka Иванов Петрова Смирнов Παπαδάκης Νικολάου Kovačević Ștefănescu Ðorđević".split()
_CJK_FAMILY, _CJK_GIVEN, _CJK_TITLES = "王李张刘陈杨黄赵周吴", "伟芳娜敏静强磊军洋艳", ["先生", "女士", "小姐", "老师", "医生", "教授"]
_TRAILS = "Oak Elm Maple River Park Hill Church Mill Station Garden Spring Lake Birch Castle Bridge Market Forge Meadow Chapel Orchard".split()
_EN_TYPES = "Street St Road Rd Avenue Ave Lane Drive Close Court Row Way Place Terrace Square".split()
_DE_STEMS = "Linden Garten Bahnhof Kirch Schul Berg Wald Haupt Rosen Mühlen Birken Kastanien Ahorn Amsel Krähen".split()
_DE_TYPES = ["straße", "str.", "weg", "allee", "platz", "gasse", "ring", "strasse"]
_FR_TYPES = ["rue", "chemin", "avenue", "impasse", "boulevard", "allée", "place", "quai"]
_FR_NAMES = ["des Lilas", "du Moulin", "de la Gare", "des Carrières", "du Vieux Pont", "des Tilleuls", "Victor", "de l'Église", "des Roses", "Saint-Martin"]
_ES_TYPES = ["Calle", "Avenida", "Plaza", "Camino", "Paseo"]
_ES_NAMES = ["del Olmo", "Mayor", "de la Ribera", "Real", "Viejo", "de los Pinos", "del Molino", "San Juan", "de la Fuente"]
_DE_PLACES = ["Am Alten Markt", "An der Mühle", "Im Grünen Winkel", "Auf dem Hügel", "Am Hafen", "An der Alten Brücke", "Am Speicher", "Zum Anger"]
_TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Mr", "Herr", "Frau", "Madame", "Monsieur", "Señora", "Señor", "Sra.", "Mme"]
_DIGITS = {
    "en": "zero one two three four five six seven eight nine".split(), "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(),
    "fr": "zéro un deux trois quatre cinq six sept huit neuf".split(), "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split(),
}


class Maker:
    def __init__(self, seed: int, given: list[str]) -> None:
        self.r = random.Random(seed)
        self.given_names = given

    def d(self, n: int, first: str = "0123456789") -> str:
        return self.r.choice(first) + "".join(self.r.choice("0123456789") for _ in range(n - 1))

    def given(self) -> str:
        return self.r.choice(self.given_names)

    def family(self) -> str:
        r = self.r
        if r.random() < 0.06:
            return r.choice(_OTHER)
        one = r.choice(_STARTS) + (r.choice(_MIDDLES) if r.random() < 0.6 else "") + r.choice(_ENDS)
        if r.random() < 0.1:
            return f"{one}-{self.family().split('-')[0]}"
        if r.random() < 0.06:
            return r.choice(["O'", "Mc", "D'"]) + one
        return one

    def town(self) -> str:
        r = self.r
        return r.choice(_STARTS) + r.choice(["mere", "furt", "au", "ville", "low", "stad", "haven", "rosa", "court", "ia"]) if r.random() < 0.8 else r.choice(_TRAILS) + " " + r.choice(["Point", "Bay", "Hill", "Harbour"])

    def name(self) -> str:
        r, g, f = self.r, self.given(), self.family()
        form = r.random()
        if form > 0.98:
            return r.choice(_CJK_FAMILY) + "".join(r.choices(_CJK_GIVEN, k=r.randint(0, 2))) + r.choice(_CJK_TITLES)
        if form < 0.4:
            return f"{g} {f}"
        if form < 0.46:
            return f"{g} {r.choice('ABCDEFGHJKLMNPRST')}. {f}"
        if form < 0.57:
            return f"{f}, {g}"
        if form < 0.64:
            return f"{g} {f}".upper()
        if form < 0.74:
            return f"{g} {f}".lower()
        if form < 0.8:
            return f"{r.choice('ABCDEFGHJKLMNPRST')}. {f}"
        title = r.choice(_TITLES)
        middle = r.choice(["", "", f"{r.choice('ABCDEFGHJKLMNPRST')}. ", f"{g} "])
        return f"{title} {middle}{f}"

    def phone(self) -> str:
        r, d = self.r, self.d
        us = (r.choice("2346789") + d(2), d(3, "23456789"), d(4))
        forms = [
            lambda: "{}-{}-{}".format(*us), lambda: "({}) {}-{}".format(*us), lambda: "{}.{}.{}".format(*us), lambda: "+1 {} {} {}".format(*us), lambda: "1-{}-{}-{}".format(*us), lambda: "+1" + "".join(us), lambda: "{} {} {}".format(*us),
            lambda: f"07{d(3)} {d(6)}", lambda: f"+44 7{d(3)} {d(6)}", lambda: f"+44 (0)20 {d(4, '789')} {d(4)}", lambda: f"(020) {d(4)} {d(4)}", lambda: f"020 {d(4)} {d(4)}", lambda: f"0044 7{d(3)}-{d(3)}-{d(3)}",
            lambda: f"+49 30 {d(5)}-{d(3)}", lambda: f"030/{d(8)}", lambda: f"030 {d(5)} {d(3)}", lambda: f"(0{d(3, '23456789')}) {d(4)}-{d(3)}", lambda: f"0049 {d(3, '2345')} {d(4)} {d(3)}", lambda: f"01{d(2)} {d(7)}", lambda: f"+49 1{d(2)} {d(7)}",
            lambda: "0" + r.choice("123456") + "".join(r.choice([" ", " ", "."]) + d(2) for _ in range(1)) + "".join(" " + d(2) for _ in range(3)), lambda: "0" + r.choice("1267") + "".join("." + d(2) for _ in range(4)), lambda: "+33 " + r.choice("1267") + "".join(" " + d(2) for _ in range(4)),
            lambda: f"+34 6{d(2)} {d(3)} {d(3)}", lambda: f"6{d(2)} {d(3)} {d(3)}", lambda: f"+34 9{d(1)} {d(3)} {d(2)} {d(2)}", lambda: f"+{d(2, '2345678')} {d(2)} {d(3)} {d(4)}",
            lambda: " ".join(r.choices(_DIGITS[r.choice("en de fr es".split())], k=r.randint(9, 12))),
        ]
        if r.random() < 0.08:
            return " ".join(r.choices(_DIGITS["en"], k=11))
        return r.choice(forms)()

    def id_number(self) -> str:
        r, d = self.r, self.d
        up = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
        nir = f"{r.choice('12')} {d(2)} {r.choice(['01', '05', '09', '12', '13', d(2)])} {d(2)} {d(3)} {d(3)} {d(2)}"
        forms = [
            lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: d(9), lambda: f"{up(2)}{d(6)}{r.choice('ABCD')}", lambda: f"{up(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", lambda: f"{up(2)}{d(6)}{r.choice('ABCD')}".lower(),
            lambda: nir, lambda: nir.replace(" ", ""), lambda: f"{up(2)}{d(1)}{up(1)}{d(5)}", lambda: f"{d(8)}{up(1)}", lambda: f"{d(8)}-{up(1)}", lambda: f"{up(1)}{d(8)}", lambda: f"{up(1)}{d(7)}{up(1)}", lambda: f"{up(2)}{d(7)}", lambda: d(11, "123456789"),
            lambda: f"{up(2)}{d(2)} {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}",
        ]
        return r.choice(forms)()

    def email(self) -> str:
        r, g, f = self.r, self.given().lower(), self.family().lower().replace("'", "").replace("-", "")
        local = r.choice([f"{g}.{f}", f"{f}-{g}", f"{g[0]}_{f}{self.d(2)}", f"{g}{r.randint(1950, 2010)}", f"{f}+lists", f"{g}{f}", f"info", f"{g}.{f}"])
        domain = r.choice(["example.org", "mail.example.com", "post.example", "my-house.test", "a.b-c.example", "firm.invalid", "uni.edu", "shop.co.uk", "web.de", "nord.net"])
        if r.random() < 0.15:
            local, domain = local.upper(), domain
        form = r.random()
        if form < 0.45:
            return f"{local}@{domain}"
        if form < 0.55:
            return f"{local} @ {domain}"
        if form < 0.7:
            return f"{local} (at) {domain.replace('.', ' (dot) ')}"
        if form < 0.82:
            return f"{local}[at]{domain}"
        return f"{local.replace('.', ' dot ')} at {domain.replace('.', ' dot ')}"

    def address(self) -> str:
        r, n, town, post = self.r, str(self.r.randint(1, 250)), self.town(), self.d(5)
        trail = r.choice([*_TRAILS, *_TRAILS, f"Old {r.choice(_TRAILS)}", self.family().split("-")[0]])
        kind = r.choice(_EN_TYPES)
        forms = [
            lambda: f"{n} {trail} {kind}, {town} {post}", lambda: f"{n} {trail} {kind}", lambda: f"{n} {trail} {kind}, {town}".lower(), lambda: f"{n} {r.choice(['old', 'new', 'upper', 'north'])} {trail} {kind}, {town}".lower(), lambda: f"Flat {r.randint(1, 40)}, {n} {trail} {kind}, {town}", lambda: f"{r.randint(1000, 9999)} {r.choice('NSEW')} {trail} {kind} Apt {r.randint(1, 40)}",
            lambda: f"{r.choice(_DE_STEMS)}{r.choice(_DE_TYPES)} {n}{r.choice(['', '', 'a', 'b', ' c'])}, {post} {town}", lambda: f"{r.choice(_DE_STEMS)}{r.choice(_DE_TYPES)} {n}", lambda: f"{r.choice(_DE_PLACES)} {n}{r.choice(['', 'a', 'b'])}, {post} {town}",
            lambda: f"{n}, {r.choice(_FR_TYPES)} {r.choice(_FR_NAMES)}, {post} {town}", lambda: f"{n} {r.choice(_FR_TYPES)} {r.choice(_FR_NAMES)}", lambda: f"{r.choice(_ES_TYPES)} {r.choice(_ES_NAMES)} {n}, {r.randint(1, 6)}.º {r.choice('ABCD')}, {post} {town}", lambda: f"{r.choice(_ES_TYPES)} {r.choice(_ES_NAMES)}, {n}",
        ]
        return r.choice(forms)()


#: Carriers of each kind; {0} is what is marked. Half of all examples get none of a kind's own carriers.
CARRIERS = {
    "email": ["You can reach my sister at {0} these days.", "Forward the pictures to {0}.", "Mail {0} about the tickets.", "{0} bounced twice.", "Antworte einfach an {0}.", "Unter {0} antwortet niemand.", "Envoie les photos à {0}.", "Mándalo a {0} cuando puedas.", "The newsletter goes out to {0} only.", "Sign in with {0} as usual.", "Reply-to: {0}", "<{0}>", "The landlord reads {0} once a week.", "He lists {0} on his card; never used it."],
    "phone": ["Phone me on {0} tonight.", "Her mobile is {0} now.", "I rang {0} twice yesterday.", "A voicemail came from {0}!", "{0} – the garage, in case it breaks down.", "Melde dich unter {0}.", "{0}, am besten abends.", "Tel. {0}", "Mon portable, c'est le {0}.", "Mi móvil es el {0}.", "The clinic answers at {0}.", "Der Hausmeister hat die {0}.", "Text {0} before you leave.", "Fax it to {0}.", "Reach the office under {0} until four."],
    "id_number": ["Passport number {0}, valid until June.", "Her insurance number is {0}.", "I wrote {0} in the tax field and it was refused.", "National identity card: {0}.", "Mein Personalausweis hat die Nummer {0}.", "Als Steuernummer steht {0} im Bescheid.", "Mon numéro d'identité est le {0}.", "Su DNI era {0}.", "The clerk asked for the SSN, so {0} it was.", "{0} is on my driving licence.", "He read {0} off his passport.", "The visa form says {0} as the document of the traveller.", "Social security: {0}", "My tax number begins like {0} does."],
    "address": ["Our new flat is at {0}.", "Post the letter to {0}, would you?", "My aunt has lived at {0} for years.", "Ship it to: {0}", "Wir sind nach {0} gezogen.", "Schick die Karte nach {0}.", "Das Büro liegt {0}.", "Nous habitons au {0}.", "La oficina está en {0}.", "Meet me outside {0} at noon.", "The removal van stops at {0} tomorrow.", "Home: {0}", "Someone rang the bell at {0} last night.", "The bill was addressed to {0}."],
    "name": ["{0} rented us the boat.", "Yesterday {0} called the plumber.", "My interview is with {0} next week.", "The form was filled in by {0}.", "Ich habe {0} im Zug getroffen.", "{0} hat den Vertrag verlängert.", "Der Brief kam von {0}.", "J'ai dîné avec {0}.", "Vi a {0} en la estación.", "Our tutor is called {0}.", "I bought the bike from {0}.", "{0} looks after the garden.", "Yours, {0}", "The parcel was signed for by {0}.", "Say hello to {0} from me.", "{0}, our neighbour, moved out."],
}
BARE = ["{0}", "So, {0}.", "Then it says: {0}", "{0} once more", "Didn't I write {0} yesterday?", "Remember: {0}."]


def negatives(m: Maker) -> list[str]:
    """One sentence of each sort that holds something alike which isn't personal."""
    r, d = m.r, m.d
    f, g, t, trail = m.family(), m.given(), m.town(), r.choice(_TRAILS)
    up = "".join(r.choice("ABCDEFGHKLMNPRSTX") for _ in range(2))
    verb = r.choice(["thinks", "booked us in", "said", "paid", "wants", "told me", "meint", "holds", "has left", "will collect it", "visits", "started", "likes", "forgot", "writes"])
    order = r.choice([f"{d(4)}-{d(3)}-{d(5)}", f"{d(3)}-{d(7)}-{d(7)}", d(10), f"{up}-{d(4)}-{d(3)}-{d(5)}", d(8)])
    way = f"{r.choice(['runs', 'stops', 'turns', 'leads', 'drives', 'heads', 'carries on', 'gets you', 'people walked', 'of us met', 'minutes later', 'starts'])} {r.choice(['', '', 'right ', 'directly ', 'only ', 'back '])}{r.choice(['to', 'at', 'near', 'past', 'into', 'along', 'off', 'from'])} {trail} {r.choice(_EN_TYPES)}{r.choice(['', ', then left', ', which helps', ', as always', f', {t}'])}"
    thing = r.choice(["theorem", "algorithm", "diet", "technique", "approach", "sauce", "syndrome", "brochure", "bakery", "foundation", "museum", "collection"])
    return [
        f"Everyone praises the {f} {thing}.", f"A {f} {thing} costs too much.", f"Have you tried the {f} {thing}?", f"{f} & Daughters sell paint.", f"{f} & Co. shut at five.", f"We swam in Lake {f}.", f"All {t} {f}s players are ill.", f"The St. {g} parade of {t} was cancelled.", f"{g} {verb} on Monday.", f"{g} came in at {d(2)} minutes.",
        f"{trail} Hall of {t} opens later.", f"Is {trail} Point open on Sundays?", f"{trail} Lane floods every spring.", f"{r.choice(['Line', 'Tram', 'The', 'Bus', 'Number'])} {d(2)} {way}.", f"Take the {d(2)}, it {way}.", f"{d(2)} {way}.", f"We swam in Lake {f}, {g} as well.", f"At {trail} Hall, {g} sang.", f"{trail} {r.choice(['Hall', 'Court', 'Bay', 'Point', 'House'])}, {g} {verb}.", f"Line {d(2)} stops at {trail} Road nowadays.", f"{g} rides line {d(2)} down {trail} Street.", f"We reserved court {d(2)} in {trail} Hall.", f"In der {r.choice(_DE_STEMS)}straße wird gebaut, Umleitung {d(2)}.",
        f"There is a fountain on {trail} Avenue.", f"{g} grew up around {trail} Row, {t}.", f"Some {d(2)} people marched down {trail} Street for {d(1)} hours.", f"It took {d(2)} weeks on the way.", f"I counted {d(2)} lamps along {trail} Court.",
        f"My order {order} never left the depot.", f"Shipment {order} is at the door.", f"My ticket number reads {up}-{d(4)}-{d(3)}-{d(5)} as far as I see.", f"The ISBN: 978-{d(1)}-{d(4)}-{d(3)}-{d(5)}.", f"Book: ISBN 978-{d(1)}-{d(3)}-{d(5)}-{d(1)} by the way.", f"Bestellnummer {order} fehlt noch.", f"Le colis {order} est perdu.", f"La factura {order} ya está pagada.", f"Please settle invoice {order} soon.",
        f"It ended {d(2)}-{d(2)}-{d(2)} after overtime.", f"The shelf is {d(2)} x {d(2)} x {d(2)} cm.", f"The bill came to {d(3)}.{d(2)} euros.", f"Release {d(1)}.{d(2)}.{d(1)} fixes it.", f"Install app@{d(1)}.{d(2)}.{d(1)} first.", f"The log of 20{d(2)}-0{d(1, '123456789')}-1{d(1)} 1{d(1)}:{d(1, '12345')}0 is empty.", f"From 20{d(2)} to 20{d(2)} they made {d(3)} {d(3)} {d(3)} pieces.", f"Tracking code {up}{d(9)}{up} shows nothing.", f"Its serial number was {up}{d(8)}.", f"Checked out {r.choice('abcdef')}{d(3)}{r.choice('abcdef')}{d(2)}{r.choice('abcdef')}{d(3)} again.", f"Checksum {r.choice('abcdef')}{d(2)}{r.choice('abcdef')}{r.choice('abcdef')}{d(6)} is off.", f"We have {d(4)} {d(4)} bonus points.",
        f"{g} streams as @{g.lower()}_{d(2)} now.", f"Come at {d(1)} @ the lido.", f"There is a dot at home on the plan.", f"We were at work at nine.", f"Follow @{g.lower()}.{d(2)} there.", f"It is on www.example.com already.", f"I lost my ID card again.", f"{g}: No idea.", f"{g}: {r.choice(['Ring', 'Maybe', 'Train', 'Our', 'A', 'Before'])} the others.", f"Odd, {g} never wrote.", f"I waved at {g}. {trail} Street was dark.",
        f"Das Rudern mit {g} hat geklappt.", f"Da saßen {d(2)} Gäste.", f"Am Freitag kommen {d(1)} Freunde.", f"Am {d(2)} Mai ist frei.", f"Kennst du {t} im Winter?", f"Gegenüber steht das Alte Museum von {t}.", f"the {f.lower()} {thing}", f"{g} or {m.given()} may know.", f"{g} and {m.given()} cooked.", f"{m.given()}, {g} and I danced.", f"The {t} Court of Appeal agreed.", f"two, three and four or five six", f"Kind Regards from New Harbour", f"Merry Christmas {g}!", f"Only {g} laughed.", f"Dinner with {g} on Friday.", f"{r.choice(_TITLES)} left.", f"{f} Partners merged with {trail} Ltd.", f"Wir kauften bei {f} Möbel ein.", f"the {trail} {thing} in {t}",
    ]


def examples(n: int, seed: int, given: list[str]) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` rounds of sentences, each a text and the (start, end, kind) in it."""
    m = Maker(seed, given)
    out: list[tuple[str, list[tuple[int, int, str]]]] = []
    for _ in range(n):
        plain = negatives(m)
        for kind, carriers in CARRIERS.items():
            value = getattr(m, kind)()
            carrier = m.r.choice(carriers if m.r.random() < 0.75 else BARE)
            at = carrier.index("{0}")
            before = m.r.choice(["", "", m.r.choice(plain) + " ", f"{m.given()}: "])
            text = before + carrier.replace("{0}", value) + m.r.choice(["", "", " " + m.r.choice(plain)])
            out.append((text, [(len(before) + at, len(before) + at + len(value), kind)]))
        out += [(x, []) for x in m.r.sample(plain, 16)]
    return out
