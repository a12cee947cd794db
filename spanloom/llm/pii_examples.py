"""Made-up texts with known personal information, to fit and calibrate the models of pii.

Words are drawn from syllables, name parts from the lexicon, numbers from the formats of the five countries. A share of the name parts is
withheld from what the features call known, as names in texts aren't all in the lexicon either. Much that only looks like personal
information stands beside it: shelf marks, pages, prices, dates, lone names, streets without numbers.
"""

from __future__ import annotations

import random

from spanloom.llm.pii import CUE

# ---- fixed values: ordinary captions and phrases of letters, forms and registers, {} is the place of the information ----
NAME_FRAMES = {
    "de": ["Unterschrift: {}", "Hochachtungsvoll, {}", "gezeichnet {}", "laut {} wäre", "Frau {} meldete", "Herr {} bestellte", "Dr. {} bestätigt", "Ansprechpartner {}", "verfasst von {}", "Sehr geehrte Frau {}", "bei {} abgeholt", "{} sagte dazu", "{} und"],
    "en": ["Yours sincerely, {}", "sgd. {}", "as told by {} in", "Mrs {} asked", "Mr. {} agreed", "Dear {}", "written by {}", "collected from {} on", "Attn. {}", "{} said so", "{} and", "signed {}", "Author: {}"],
    "fr": ["Signature : {}", "soussigné {}", "d'après {}, on", "Mme {} demanda", "M. {} accepta", "Cher {}", "rédigé par {}", "reçu de {} en", "chez {}", "{} disait", "{} et", "Auteur : {}", "À l'attention de {}"],
    "it": ["In fede, {}", "f.to {}", "stando a {}, si", "La signora {} chiese", "Il dott. {} accettò", "Caro {}", "scritto da {}", "ricevuto da {} nel", "presso {}", "{} diceva", "{} e", "Autore: {}", "Alla c.a. di {}"],
    "nl": ["Hoogachtend, {}", "w.g. {}", "naar zeggen van {} was", "Mevrouw {} vroeg", "Dhr. {} ging akkoord", "Beste {}", "geschreven door {}", "ontvangen van {} in", "ten huize van {}", "{} zei", "{} en", "Auteur: {}", "T.a.v. {}"],
}
PHONE_FRAMES = {
    "de": ["Tel.: {}", "Rückruf unter {} erbeten", "Mobil: {}", "Durchwahl {}", "Fax {}", "Rufnummer {} wählen", "oder {} (abends)"],
    "en": ["Tel. {}", "phone: {}", "please dial {} and", "mobile {}", "Fax: {}", "my number is {} if", "or {} (evenings)"],
    "fr": ["Tél. : {}", "composer le {} svp", "portable: {}", "fax {}", "joindre au {} le", "ou {} (soir)"],
    "it": ["Tel. {}", "cell.: {}", "comporre il {} oppure", "fax {}", "recapito {}", "o {} (sera)"],
    "nl": ["Tel. {}", "mobiel: {}", "draai {} en", "fax {}", "doorkiesnummer {}", "of {} ('s avonds)"],
}
ID_FRAMES = {
    "de": ["Steuernummer: {}", "Reisepass {}", "IdNr. {}", "Kennung {} eingetragen", "Sozialversicherung {}", "unter {} gemeldet"],
    "en": ["NI number: {}", "passport {}", "SSN {}", "ID no. {} recorded", "ID {}", "NI {}", "social security {}", "registered as {} in"],
    "fr": ["n° de sécu : {}", "passeport {}", "NIR : {}", "NIR {}", "identifiant {} inscrit", "matricule {}", "enregistré sous {} en"],
    "it": ["C.F.: {}", "CF {}", "passaporto {}", "cod. fisc. {}", "identificativo {} annotato", "tessera {}", "registrato con {} nel"],
    "nl": ["BSN: {}", "BSN {}", "paspoort {}", "sofi-nr. {}", "identificatie {} genoteerd", "persoonsnummer {}", "ingeschreven als {} in"],
}
ADDRESS_FRAMES = {
    "de": ["Anschrift: {}", "Geschäft in {}", "Besuchen Sie uns: {}, Eingang", "zieht nach {} um", "am Haus {} vorbei"],
    "en": ["Shop at {}", "Our address: {}", "Visit us, {}, side door", "moving to {} soon", "past {} and"],
    "fr": ["Siège : {}", "boutique au {}", "Venez au {}, porte", "déménage au {} en", "devant {} puis"],
    "it": ["Sede: {}", "negozio in {}", "Venite in {}, ingresso", "trasloca in {} a", "davanti a {} poi"],
    "nl": ["Vestiging: {}", "winkel aan de {}", "Bezoek ons: {}, ingang", "verhuist naar {} in", "langs {} en"],
}
EMAIL_FRAMES = ["e-mail: {}", "Mail {} please", "an {} senden", "envoyer à {} svp", "inviare a {} oppure", "stuur naar {} of", "<{}>", "mailto:{}", "reply-to <{}>", "({})", "[{}]"]
TITLE = {"de": ["Frau", "Herr", "Herrn"], "en": ["Mrs", "Mr", "Miss"], "fr": ["Mme", "Mlle"], "it": ["La signora", "Sig."], "nl": ["Mevrouw", "Dhr."]}
PARTICLES = {"de": ["von", "zu", "von der"], "en": [], "fr": ["de", "du", "de la"], "it": ["di", "della", "del"], "nl": ["van", "van der", "ter", "van den"]}
LURES = {
    "de": ["Artikel {4} {3} {3}", "Ref. {4}-{3} im Lager", "vgl. S. {2}-{3}.", "Kosten: {3},{3} Euro @ Stück.", "Stand {d}.{m}.{y} neu", "Bestell-Nr. {4}-{4}", "Gleis {2} links"],
    "en": ["Item {4} {3} {2}", "Ref. {4}-{3} in stock", "cf. pp. {3}-{3}.", "{3} units @ {2} each.", "dated {d}/{m}/{y} or", "order {4}-{4}", "Platform {2} left"],
    "fr": ["Article {4} {3} {3}", "Réf. {4}-{3} en stock", "cf. p. {2}-{3}.", "{3} pièces @ {2} francs.", "daté du {d}.{m}.{y} ou", "commande {4}-{4}", "numéro inconnu {2}"],
    "it": ["Articolo {4} {3} {2}", "Rif. {4}-{3} in magazzino", "cfr. pp. {3}-{3}.", "{3} pezzi @ {2} lire.", "in data {d}.{m}.{y} o", "ordine {4}-{4}", "civico ignoto {2}"],
    "nl": ["Artikel {4} {3} {3}", "Ref. {4}-{3} op voorraad", "vgl. p. {2}-{3}.", "{3} stuks @ {2} gulden.", "gedateerd {d}-{m}-{y} of", "bestelling {4}-{4}", "spoor {2} links"],
}
DE_STREETS, NL_STREETS = ["straße", "str.", "gasse", "weg", "platz", "allee"], ["straat", "gracht", "kade", "steeg", "weg", "laan", "str.", "plein"]
EN_STREETS, FR_STREETS = ["Street", "St", "Lane", "Row", "Close", "Road", "Rd"], ["rue", "r.", "av.", "avenue", "impasse", "quai", "place", "bd"]
IT_STREETS = ["Via", "via", "V.le", "Viale", "Piazza", "Vicolo", "Corso"]
DOMAINS = ["letters.example", "post.haus.test", "mail.archive.invalid", "odour.example.org", "big-nose.example", "salt.test"]
# ---- end of fixed values ----
SYLLABLES = "ba be bri chou da del fi flan ga gru hei jo ka kle lan lo mar mie na no pa per pli qua ra ren sa schu so sta ta ter tru va ven wol zo zei".split()

#: The share of names after a title or a phrase of signing of which no part is in the lexicon.
UNLISTED = 0.15
#: The share of names of many given names, and of phone numbers written digit by digit.
LONG = 0.08


class Maker:
    """Draws texts; ``spans`` of the last text are (start, end, kind)."""

    def __init__(self, rows: list[tuple[str, str, str]], draw: random.Random):
        self.draw, self.apart = draw, random.Random(17)
        self.parts = {(k, lang): [p for p, kind, of in rows if kind == k and (of == lang or not of)] or [p for p, kind, _ in rows if kind == k] or ["Anna"] for k in ("given", "surname") for lang in NAME_FRAMES}

    def word(self) -> str:
        return "".join(self.draw.choice(SYLLABLES) for _ in range(self.draw.randint(1, 3)))

    def digits(self, n: int) -> str:
        return "".join(self.draw.choice("0123456789") for _ in range(n))

    def name(self, lang: str) -> str:
        d = self.draw
        given, surname = d.choice(self.parts["given", lang]), d.choice(self.parts["surname", lang])
        if d.random() < 0.12:
            surname += "-" + d.choice(self.parts["surname", lang])
        gap = d.choice([" "] * 8 + ["\u00a0", "\u2009"])
        particle = d.choice(PARTICLES[lang]) + " " if PARTICLES[lang] and d.random() < 0.35 else ""
        initials = "".join(d.choice("ABCDEFGHIJKLMNOPRSTVWÉ") + "." + d.choice([" ", " ", ""]) for _ in range(d.randint(1, 2))).strip()
        if self.apart.random() < LONG:
            return " ".join([*(self.apart.choice(self.parts["given", lang]) for _ in range(self.apart.randint(3, 9))), particle + surname])
        form = d.random()
        if form < 0.2:
            return f"{surname}, {given if d.random() < 0.9 else initials}"
        name = f"{initials if form < 0.42 else given}{gap}{particle}{surname}" if form < 0.94 else f"{given} {d.choice(self.parts['given', lang])} {particle}{surname}"
        return name.upper() if d.random() < 0.06 else name

    def unlisted(self) -> str:
        """A full name of two parts that no lexicon has. Its draws are apart, so that all else of the texts is as without it."""
        return " ".join("".join(self.apart.choice(SYLLABLES) for _ in range(self.apart.randint(2, 4))).capitalize() for _ in range(2))

    def email(self, lang: str) -> str:
        d = self.draw
        given, surname = d.choice(self.parts["given", lang]).lower(), d.choice(self.parts["surname", lang]).lower()
        local = d.choice([f"{given}.{surname}", given[0] + surname, f"{surname}-1{self.digits(3)}", f"{given}+archive", given + self.digits(2), f"{surname}_{given[0]}"])
        domain = d.choice(DOMAINS)
        at, dot = d.choice([("@", ".")] * 6 + [(" @ ", "."), ("[at]", "[dot]"), (" (at) ", "."), (" AT ", " DOT "), (" at ", " dot "), ("(at)", "(dot)")])
        if at.strip() == "@" and d.random() < 0.15:
            local, domain = (local.upper(), domain.upper()) if d.random() < 0.5 else (local.title(), domain.title())
        return local + at + domain.replace(".", dot)

    def phone(self, lang: str) -> str:
        number = self._phone(lang)
        return " ".join(c for c in number if c in "+0123456789") if self.apart.random() < LONG else number

    def _phone(self, lang: str) -> str:
        d, n = self.draw, self.digits
        s = d.choice([" ", " ", " ", "-", ".", "\u00a0", "\u2009"])
        return d.choice(
            {
                "de": [f"+49 30 2{n(4)} {n(3)}", f"+49(0)30{s}2{n(4)}{s}{n(3)}", f"030/{n(5)}-{n(3)}", f"(030) {n(5)} {n(3)}", f"0049{s}30{s}{n(8)}", f"0{n(3)} {n(7)}"],
                "en": [f"+44 1632 {n(6)}", f"(01632) {n(6)}", f"01632{s}{n(3)}{s}{n(3)}", f"555-{n(4)}", f"({n(3)}) 555-{n(4)}", f"+1{s}{n(3)}{s}555{s}{n(4)}", f"0{n(4)} {n(6)}"],
                "fr": [f"0{n(1)}{s}{n(2)}{s}{n(2)}{s}{n(2)}{s}{n(2)}", f"0{n(9)}", f"+33 {n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"+33 (0){n(1)}.{n(2)}.{n(2)}.{n(2)}.{n(2)}", f"0033{s}{n(1)}{s}{n(2)}{s}{n(2)}{s}{n(2)}{s}{n(2)}"],
                "it": [f"06{d.choice(['/', '-', ' ', '.', s])}{n(8)}", f"(06) {n(4)}-{n(4)}", f"+39 06 {n(4)} {n(4)}", f"0039{s}06{n(8)}", f"0{n(2)}/{n(7)}"],
                "nl": [f"020-{n(7)}", f"020{n(7)}", f"+31 20 {n(3)} {n(4)}", f"+31 (0)20{s}{n(3)}{s}{n(2)}{s}{n(2)}", f"0031{s}20{s}{n(7)}"],
            }[lang]
        )

    def number(self, lang: str) -> str:
        d, n = self.draw, self.digits
        s = d.choice([" ", "", "."])
        a = lambda k: "".join(d.choice("ABCDFGHKLMNPRSTVZ") for _ in range(k))
        code = d.choice(["", " "])
        return d.choice(
            {
                "de": [f"{n(2)} {n(3)} {n(3)} {n(3)}", n(11), f"{a(1)}{n(1)}{a(1)}{n(2)}{a(2)}{n(2)}"],
                "en": [f"{a(2)}{n(6)}{a(1)}", f"QQ {n(2)} {n(2)} {n(2)} {d.choice('ABCD')}", f"9{n(2)}-{n(2)}-{n(4)}", f"{n(3)}-{n(2)}-{n(4)}"],
                "fr": [s.join([d.choice("12"), n(2), f"{d.randint(1, 12):02d}", n(2), n(3), n(3), n(2)])],
                "it": [f"{a(6)}{code}{n(2)}{d.choice('ABCDEHLMPRST')}{n(2)}{code}Z{n(3)}{a(1)}", f"C{a(1)}{n(5)}{a(2)}"],
                "nl": [f"{n(4)}.{n(2)}.{n(3)}", f"{n(4)} {n(2)} {n(3)}", n(9), f"N{a(1)}{n(7)}"],
            }[lang]
        )

    def address(self, lang: str) -> str:
        d = self.draw
        n = d.randint(1, 250)
        w = self.word().capitalize()
        if d.random() < 0.25:
            w = d.choice(self.parts["surname", lang])
        if lang in ("de", "nl"):
            suffix = d.choice(["", "", "", d.choice("abc"), f" {d.choice('ABC')}", f"/{d.randint(1, 3)}" if lang == "de" else f"-{d.choice(['I', 'II', 'III'])}"])
            return f"{w}{d.choice(DE_STREETS if lang == 'de' else NL_STREETS)} {n}{suffix}"
        if lang == "en":
            name = " ".join([w, *[self.word().capitalize()] * (d.random() < 0.2)])
            return f"{n}{d.choice(['', '', '', 'A', 'b', f'-{n + 2}'])} {name} {d.choice(EN_STREETS)}"
        if lang == "fr":
            name = "-".join([w, *[self.word().capitalize()] * (d.random() < 0.5)])
            return f"{n}{d.choice(['', '', ' bis', ' ter'])}{d.choice(['', ','])} {d.choice(FR_STREETS)} {d.choice(['des', 'du', 'de la'])} {name}"
        name = " ".join([w, *[self.word().capitalize()] * (d.random() < 0.4)])
        return f"{d.choice(IT_STREETS)} {d.choice(['dei', 'delle', 'del'])} {name}{d.choice([' ', ', ', ' n. '])}{n}{d.choice(['', '', '/A', '/bis', '/B'])}"

    def lure(self, lang: str) -> str:
        d = self.draw
        if d.random() < 0.45:
            given, surname, title = d.choice(self.parts["given", lang]), d.choice(self.parts["surname", lang]), d.choice(TITLE[lang])
            frame = d.choice(NAME_FRAMES[lang])
            return d.choice([f"{title} {surname}", f"{title} {given}", surname, given, f"{given} {self.word().capitalize()}", f"{self.word().capitalize()} {given}", frame.format(f"{title} {surname}"), frame.format(given), f"{given}, {self.word()}", f"{self.word()}, {surname}, {self.word()}", f"{self.word().capitalize()} {self.word().capitalize()}"])
        if lang in ("de", "nl") and d.random() < 0.25:  # a word that ends as streets do, before a year
            return f"{self.word()}{d.choice(DE_STREETS if lang == 'de' else NL_STREETS).rstrip('.')}{d.choice(['', 'ring'])} 1{d.randint(600, 950)}"
        out = d.choice(LURES[lang]).replace("{y}", f"1{d.randint(600, 950)}").replace("{d}", f"{d.randint(1, 28):02d}").replace("{m}", f"{d.randint(1, 12):02d}")
        for n in "234":
            while f"{{{n}}}" in out:
                out = out.replace(f"{{{n}}}", str(d.randint(1, 9)) + self.digits(int(n) - 1), 1)
        return out

    def text(self) -> tuple[str, set[tuple[int, int, str]]]:
        """A text of some sentences and blocks, and its spans."""
        d = self.draw
        lang = d.choice(list(NAME_FRAMES))
        out, spans = "", set()
        make = {"email": self.email, "phone": self.phone, "id_number": self.number, "address": self.address, "name": self.name}
        frames = {"phone": PHONE_FRAMES[lang], "id_number": ID_FRAMES[lang], "address": ADDRESS_FRAMES[lang], "name": NAME_FRAMES[lang], "email": EMAIL_FRAMES}

        def put(kind: str, frame: str) -> None:
            nonlocal out
            before, after = frame.split("{}")
            piece = make[kind](lang)
            if kind == "name" and CUE.search(before) and self.apart.random() < UNLISTED:
                piece = self.unlisted()
            out += before
            spans.add((len(out), len(out) + len(piece), kind))
            out += piece + after

        def filler() -> None:
            nonlocal out
            words = [self.word() for _ in range(d.randint(1, 6))]
            if d.random() < 0.15:
                words.insert(d.randint(0, len(words)), str(d.choice([d.randint(1600, 1930), d.randint(2, 140)])))
            if lang == "de":
                words = [w.capitalize() if d.random() < 0.3 else w for w in words]
            if d.random() < 0.6:
                words[0] = words[0].capitalize()
            out += " ".join(words)

        for _ in range(d.randint(2, 6)):
            what = d.random()
            if what < 0.12:  # lines of a card, or one line of it
                gap = d.choice(["\n", "\n", " · ", " | "])
                kinds = [k for k in ("name", "address", "phone", "email") if d.random() < 0.8] or ["name"]
                out += "\n"
                for i, kind in enumerate(kinds):
                    put(kind, ("" if i == 0 else gap) + "{}")
                out += d.choice(["\n", " \n", " "])
            elif what < 0.55:
                kind = d.choice(list(make))
                inline = d.random() < 0.45
                if inline:
                    filler()
                    word = d.choice(frames[kind]).split("{}")[0].strip().split(" ")[-1].lower() if kind in ("phone", "id_number") and d.random() < 0.6 else ""
                    word = word + d.choice([" ", ": "]) if word and not word.endswith("<") else ""
                    put(kind, d.choice([f", {word}{{}}, ", f" ({word}{{}}) ", f" – {word}{{}} – ", f" {word}{{}} " if word else ", {}, "]))
                    filler()
                else:
                    put(kind, d.choice(frames[kind]))
                    if kind == "name" and d.random() < 0.3:
                        out += " " + self.word().capitalize()
                out += d.choice([". ", ".\n", " ", "\n", ", "])
            elif what < 0.8:
                out += self.lure(lang)
                out += d.choice([". ", " ", "\n", ", "])
            filler()
            out += d.choice([". ", ".\n", " ", "\n", "; ", ", "])
        return out, spans


def examples(rows: list[tuple[str, str, str]], n: int, seed: int, withheld: float = 0.15) -> tuple[list[tuple[str, set[tuple[int, int, str]]]], list[tuple[str, str]]]:
    """``n`` texts with their spans, and the (name_part, kind) that count as known in them."""
    draw = random.Random(seed)
    maker = Maker(list(rows), draw)
    made = [maker.text() for _ in range(n)]
    return made, [(p, k) for p, k, _ in rows if k == "particle" or draw.random() >= withheld]
