"""Labelled spans for training and holdout: made-up lines with personal data put in at known places.

Nothing here is read or copied from any table of this project.  Plain words come from the vocabulary
of a public tokenizer (its path is a parameter), so the words around an item are as good as random and
the model has to go by the item's own shape; names, streets and places are put together from syllables
and short lists of what is common in several languages.
"""

from __future__ import annotations

import base64
import random
import string

#: Common given names of several languages; others are made of syllables.
_GIVEN = (
    "Aaron Adam Agnes Ahmed Alan Albert Alice Alicia Amelia Amit Ana Anders Andrea Anja Anna Antonio Arthur Astrid Aurora Barbara Beatriz Bernd Bianca Boris Brian Bruno Camille Carla Carlos Carol Cecilia Charlotte Chen Chiara Christine Clara Claudia Colin Cristina Dagmar Deepa Denis Diana Diego Dimitri Dmitry Donald Dora "
    "Eduardo Elena Elias Elin Elise Emil Emily Enrico Erik Esther Eva Fabian Farid Fatima Felix Fiona Frank Frida Gareth George Gerd Giulia Giuseppe Grace Greta Gustav Hana Hannah Hans Harriet Hassan Heidi Helen Helga Henry Hiroshi Igor Ines Ingrid Irene Isabel Ivan Jacob Jan Jane Javier Jens Jessica Joan Joao Johan John Jorge "
    "Jose Judith Julia Karen Karl Kenji Kevin Klaus Lars Laura Lea Leila Linda Lin Lucas Lucia Luis Magnus Marco Maria Marie Mark Marta Martin Mary Mateo Mei Mikhail Mohamed Nadia Natalia Nina Nora Olaf Olga Oscar Pablo Paolo Paul Pavel Pedro Peter Petra Pierre Rachel Rahul Raj Ravi Rosa Ruth Sara Sebastian Sergei Sofia Sonja Susan "
    "Sven Tanja Teresa Tim Tomas Ulrike Ursula Vera Victor Walter Wanda Wendy Xavier Yan Yasmin Yuki Yuri Zhang"
).split()
#: Common family names of several languages; others are made of syllables.
_FAMILY = "Smith Jones Taylor Brown Wilson Clark Hall Wright Müller Schmidt Weber Fischer Wagner Becker Hoffmann Koch Richter Klein García Martínez López Sánchez Fernández Ruiz Moreno Rossi Russo Ferrari Romano Ricci Martin Bernard Dubois Durand Moreau Lefèvre Nguyen Tran Kim Park Lee Wang Li Liu Chen Yamamoto Tanaka Suzuki Sato Kowalski Nowak Ivanov Petrov Popov Novák Horvat Kumar Singh Patel Sharma Khan Ali Hansen Nielsen Larsen Andersson Silva Santos Costa Pereira O'Brien Murphy Kelly".split()
_ENDS = "son sen berg mann stein ski sky ov ova enko ez es ini etti oni ard eau elli aki opoulos ington ford ley ton er ert wald bach feld hoff strom lund dal vik ic ak ek ish kar pur dez ault ier in".split()
_ONSET = ["", *"b c d f g h j k l m n p r s t v w y z".split(), *"bl br ch cl cr dr fl fr gl gr kl kn kr ph pl pr qu sc sh sk sl sm sn sp st str sw th tr tw vl vr wh zh ts".split()]
_VOWEL = "a e i o u a e i o u a e o ai au ei eo ia ie io oa oo ou ue ui y aa ee".split()
_CODA = ["", "", "", "", *"b c d f g k l m n p r s t v x z".split(), *"ck ct ff ft ld lf lk ll lm lt mb mp nd ng nk ns nt pt rb rd rf rg rk rl rm rn rp rt rth sh sk ss st th tz".split()]
_ACCENT = {"a": "áàäâãåă", "e": "éèêëě", "i": "íîï", "o": "óöôøõ", "u": "úüûů", "c": "çćč", "n": "ñń", "s": "šśş", "z": "žźż", "l": "ł", "r": "ř", "y": "ý"}
_PLAIN = {x: k for k, v in _ACCENT.items() for x in v}
_TLD = "example example test invalid com org net io dev de fr es it uk eu co.uk ch nl se info jp in br".split()
_TRAILERS = "Signed-off-by Reviewed-by Tested-by Co-authored-by Reported-by Acked-by Suggested-by Helped-by Cc Co-developed-by Reviewed-and-tested-by Based-on-patch-by".split()
_TITLE = "Mr Mr. Ms Ms. Mrs Mrs. Miss Dr Dr. Prof Prof. Herr Frau Mme M. Sr. Sra. Señor Madame Sir".split()
_PARTICLE = "van de|de|von|van|van der|di|da|del|de la|al|bin|dos|le|la|ter|zu".split("|")
#: Words that announce a number of a person, and others that announce a number of a thing.
_ID_WORDS = "SSN|ssn|social security|social security number|Social Security No.|tax number|tax no|tax ID|TIN|taxpayer id|passport|passport number|passport no.|Passport #|Reisepass|Reisepassnummer|national ID|national identity number|identity card|identity card no.|ID card|NI number|NINO|national insurance no.|Steuer-ID|Steuernummer|IdNr|Personalausweis|Ausweisnummer|Sozialversicherungsnummer|SV-Nummer|numéro de sécurité sociale|INSEE|NIR|carte d'identité|passeport|DNI|NIE|NIF|pasaporte|codice fiscale|BSN|PESEL|CPF|Aadhaar|CURP|personal number|personnummer|AHV|My Number".split("|")
_THING_WORDS = "order|invoice no.|serial number|ticket|issue|build|job|run|request|sensor|batch|line|offset|row|revision|port|id|object id|key|checksum|account type|part no.|article|RFC|bug|case|page|error|code|status|seed|PR|change|release|table|partition|block|frame|session|thread|pid".split("|")
_PHONE_WORDS = "phone|Phone|tel|Tel.|tel:|telephone|mobile|Mobile|cell|fax|Fax|call|Call|ring|dial|hotline|WhatsApp|text|SMS|pager|Telefon|Handy|tél.|teléfono|desk|home|work|reach|contact|extension".split("|")
_STREET_KIND = "Street Street Road Road Avenue Lane Drive Way Court Place Square Close Terrace Boulevard Crescent Row Hill St. St Rd. Rd Ave. Ave Blvd Dr. Ln".split()
_STREET_COMMON = "Main High Church Park Oak Maple Station Victoria School North South West East Green King Queen Mill Elm Spring Lake River Hill Bridge Garden Market".split()


def plain_words(vocabulary: str, most: int = 12_000) -> list[str]:
    """Lower-case words of a public byte-level vocabulary, most frequent first."""
    out = []
    with open(vocabulary, "rb") as f:
        for line in f:
            token = base64.b64decode(line.split()[0])
            if token[:1] == b" " and 3 <= len(token) <= 13 and token[1:].isalpha() and token[1:].islower() and token.isascii():
                out.append(token[1:].decode())
    return out[:most]


class Maker:
    def __init__(self, seed: int, words: list[str]) -> None:
        self.r = random.Random(seed)
        self.words = words

    # ---------------------------------------------------------------- plain text

    def w(self) -> str:
        """A word; frequent ones more often."""
        return self.words[int(len(self.words) * self.r.random() ** 2)]

    def cap(self) -> str:
        return self.w().capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice(string.digits) for _ in range(n))

    def hexa(self, n: int) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(n))

    def thing(self) -> str:
        """Something that is no word and no personal item."""
        r, w, d = self.r, self.w, self.digits
        return r.choice(
            [
                lambda: f"{w()}_{w()}", lambda: f"{w()}()", lambda: f"{w()}.{w()}()", lambda: f"`{w()}`", lambda: f'"{w()}"', lambda: f"{w()}/{w()}.{r.choice('c py rs go md txt json java'.split())}", lambda: f"{self.cap()}{self.cap()}", lambda: f"#{r.randint(1, 9999)}", lambda: f"{w().upper()}-{r.randint(1, 9999)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(1)}.{d(2)}.{d(1)}", lambda: self.hexa(r.choice((7, 8, 10, 12, 40))), lambda: f"{d(r.randint(1, 6))}",
                lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"20{d(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{d(3)}.{d(2)}.{d(1)}.{d(3)}", lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}:{d(4)}", lambda: f"@{w()}", lambda: f"@{w()}-{w()}", lambda: f"@{w()}{d(2)}", lambda: f"{w()}@{d(1)}.{d(2)}.{d(1)}", lambda: f"{w()}@v{d(1)}.{d(1)}", lambda: f"@{w()}/{w()}@{d(1)}.{d(1)}.{d(2)}", lambda: f"git@{w()}.{r.choice(_TLD)}:{w()}/{w()}.git", lambda: f"{w()}@{w()}:/{w()}/{w()}", lambda: f"{w()}@{w()}.{r.choice(_TLD)}:~/{w()}",
                lambda: f"https://{w()}.{r.choice(_TLD)}/{w()}/{d(3)}", lambda: f"ssh://git@{w()}.{w()}:{d(4)}/{w()}.git", lambda: f"https://{w()}@{w()}.{r.choice(_TLD)}/{w()}.git", lambda: f"0x{self.hexa(r.choice((2, 4, 8)))}", lambda: f"{d(r.randint(1, 3))} {r.choice('ms s KiB MB % rows bytes lines cores'.split())}", lambda: f"{d(4)}-{d(4)}", lambda: f"{d(2)}-{d(1)}", lambda: f"{d(4)}..{d(4)}", lambda: f"--{w()}={d(2)}", lambda: f"{w()}[{d(1)}]", lambda: f"{d(1)}/{d(1)}", lambda: f"{w()}={d(5)}", lambda: f"-{d(3)}", lambda: f"{d(3)},{d(3)}", lambda: f"sha256:{self.hexa(16)}", lambda: f"{w()}-{d(2)}.{d(2)}",
            ]
        )()

    def title(self) -> str:
        """Capitalised words that are no name."""
        r = self.r
        return r.choice([lambda: f"{self.cap()} {self.cap()}", lambda: f"the {self.cap()} {self.cap()}", lambda: f"{self.cap()} {self.cap()} {self.cap()}", lambda: f"{self.cap()} {self.digits(1)}", lambda: f"{self.w().upper()} {self.w().upper()}", lambda: f"{self.w().upper()[:4]} {self.cap()}", lambda: f"{self.cap()} {self.w().upper()[:3]} {self.digits(2)}", lambda: f"{self.cap()}-{self.cap()} {self.w()}", lambda: f"{self.digits(2)} {self.cap()} {self.cap()}", lambda: f"{self.cap()}, {self.cap()}", lambda: f"The {self.cap()} {self.cap()}", lambda: f"{r.choice('The Our Each No This A'.split())} {self.cap()} {self.cap()} and the {self.cap()} {self.cap()}", lambda: f"{self.cap()} {self.digits(2)} {self.cap()} {self.cap()}, {self.w()} {self.digits(2)}, {self.w()} {self.digits(1)}", lambda: f"{r.randint(1, 300)} {self.cap()} {self.cap()}, {self.w()}"])()

    def phrase(self, n: int | None = None) -> str:
        """Words with function words between them, now and then something odd."""
        r, out = self.r, []
        for _ in range(n or r.randint(2, 7)):
            roll = r.random()
            if roll < 0.42:
                out.append(r.choice("the a of in on to for with and or when is was are by from at not that this it as into after before but no its one two will can should so".split()))
            if roll > 0.93:
                out.append(self.thing())
            elif roll > 0.875:
                out.append(self.title())
            elif roll > 0.868:
                out.append(r.choice((self.given(), self.family())))  # one word alone is no name
            else:
                out.append(self.w())
        return " ".join(out)

    def sentence(self) -> str:
        r = self.r
        s = self.phrase(r.randint(3, 9))
        if r.random() < 0.2:
            s = f"{self.title()} {s}"
        if r.random() < 0.3:
            s += f"{r.choice((',', ';', ':', ' -', ' –'))} {self.phrase(r.randint(2, 5))}"
        if r.random() < 0.15:
            s += f" {r.choice(_THING_WORDS)} {self.r.choice((self.digits(r.randint(2, 10)), self.digits(3) + '-' + self.digits(4), self.digits(2) + ' ' + self.digits(3) + ' ' + self.digits(3), self.hexa(9)))}"
        s = s[:1].upper() + s[1:] + r.choice([".", ".", ".", "", "?", "!"])
        if r.random() < 0.04:
            s = "".join(r.choice(_ACCENT[ch]) if ch in _ACCENT and r.random() < 0.15 else ch for ch in s)
            if r.random() < 0.5:
                s = s.encode("utf-8").decode("latin-1")
        return s

    # ---------------------------------------------------------------- items

    def syllables(self, least: int, most: int) -> str:
        r = self.r
        out = ""
        while len(out) < 3:
            out = "".join(r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_CODA) for _ in range(r.randint(least, most)))
        return out

    def accented(self, s: str, often: float = 0.06) -> str:
        if self.r.random() > often:
            return s
        k = self.r.randrange(len(s))
        return s[:k] + self.r.choice(_ACCENT[s[k]]) + s[k + 1 :] if s[k] in _ACCENT else s

    def family(self) -> str:
        r = self.r
        roll = r.random()
        if roll < 0.2:
            return r.choice(_FAMILY)
        s = self.syllables(1, 3) + (r.choice(_ENDS) if r.random() < 0.5 else "")
        s = self.accented(s).capitalize()
        if roll > 0.97:
            s = r.choice(["Mc", "Mac", "O'", "De", "Van", "Le"]) + s
        if 0.94 < roll < 0.96:
            s += "-" + self.syllables(1, 2).capitalize()
        return s

    def given(self) -> str:
        r = self.r
        roll = r.random()
        if roll < 0.62:
            return self.accented(r.choice(_GIVEN), 0.08)
        if roll < 0.78:  # a short form
            g = r.choice(_GIVEN).lower()
            return (g[: r.randint(2, 4)] + r.choice(["", "", "y", "ie", "i", "o", "a"])).capitalize()
        return self.accented(self.syllables(1, 2) + r.choice(["", "", "a", "o", "e", "us", "ia", "ine", "el", "in", "ka", "ra", "an", "as"]), 0.1).capitalize()

    def typo(self, s: str) -> str:
        r = self.r
        if r.random() > 0.08 or len(s) < 4:
            return s
        k = r.randrange(1, len(s) - 1)
        return r.choice([s[:k] + s[k + 1 :], s[:k] + s[k] + s[k:], s[:k] + s[k + 1] + s[k] + s[k + 2 :]])

    def name(self) -> tuple[str, tuple[str, str]]:
        r = self.r
        g, f = self.given(), self.family()
        t, x = r.choice(_TITLE), r.choice(string.ascii_uppercase)
        a, b = self.typo(g), self.typo(f)
        form = r.choices(range(15), [42, 10, 8, 5, 7, 6, 6, 8, 2, 3, 2, 3, 2, 2, 3])[0]
        text = (f"{a} {b}", f"{b}, {a}", f"{g[0]}. {b}", f"{b}, {g[0]}.", f"{t} {b}", f"{t} {a} {b}", f"{a} {x}. {b}", f"{g.upper()} {f.upper()}", f"{t} {g[0]}. {b}", f"{a} {self.given()} {b}", f"{g[0]} {b}", f"{a} {r.choice(_PARTICLE)} {b}", f"{b} {a}", f'{a} "{self.given()}" {b}', f"{g[0]}.{x}. {b}")[form]
        if r.random() < 0.02 and not text.isascii():
            text = text.encode("utf-8").decode("latin-1")
        return text, (g, f)

    def _plain(self, s: str) -> str:
        return "".join(ch for ch in (_PLAIN.get(c, c) for c in s.lower()) if ch.isascii() and ch.isalnum()) or "x"

    def address(self, who: tuple[str, str] | None = None) -> tuple[str, str]:
        """(local, domain)"""
        r, w = self.r, self.w
        g, f = (self._plain(x) for x in (who or (self.given(), self.family())))
        local = r.choice(
            [
                lambda: f"{g}.{f}", lambda: f"{g}.{f}", lambda: f"{g}_{f}", lambda: f"{f}.{g}", lambda: f"{g}-{f}", lambda: f"{g[0]}{f}", lambda: f"{g[0]}.{f}", lambda: f"{f}{g[0]}", lambda: f"{g}{f}", lambda: g, lambda: f, lambda: f"{f[:4]}{g[:2]}{r.randint(1, 2000)}", lambda: f"{g}{r.randint(1, 99)}",
                lambda: w(), lambda: f"{w()}-{w()}", lambda: r.choice("bot ci build noreply no-reply info support root admin team release ops security webmaster git dev".split()), lambda: f"{self.digits(r.randint(4, 8))}+{f}{r.choice(['', self.digits(2)])}", lambda: f"{w()}+{w()}",
            ]
        )()
        if r.random() < 0.05:
            local += "+" + w()[:6]
        host = r.choice([w, w, lambda: f"{w()}-{w()}", lambda: self.family().lower(), lambda: f"{w()}{w()}"])()
        domain = f"{self._plain(host) if not host.isascii() else host}.{r.choice(_TLD)}".replace("'", "")
        if r.random() < 0.15:
            domain = f"{r.choice(['mail', 'users.noreply', 'eu', 'dev', w()])}.{domain}"
        return local, domain

    def email(self, who=None) -> str:
        r = self.r
        local, domain = self.address(who)
        roll = r.random()
        if roll < 0.68:
            return f"{local}@{domain}"
        if roll < 0.76:
            return f"{local}@{domain}".upper()
        if roll < 0.81:
            return f"{local.title()}@{domain.capitalize()}"
        at = r.choice([" at ", " at ", " [at] ", "(at)", " (at) ", "[at]", " AT ", " @ ", " <at> ", "{at}", " {at} ", "_at_", "_AT_", "＠", "[@]", " [AT] ", "-at-", "(@)"])
        dot = r.choice([".", ".", " dot ", "[.]", " [dot] ", "(dot)", " DOT ", " (dot) ", "_dot_", "{dot}", " . "])
        return (local.replace(".", dot) if r.random() < 0.3 else local) + at + domain.replace(".", dot)

    def phone(self) -> str:
        r, d = self.r, self.digits
        cc, sep = r.choice((1, 7, 31, 33, 34, 39, 41, 44, 46, 49, 55, 61, 81, 86, 91, 351, 420)), r.choice((" ", "-", ".", " ", "-"))
        plus = r.choice(["+", "+", "+", "00", "＋"])
        return r.choice(
            [
                lambda: f"{plus}{cc}{sep}{d(3)}{sep}{d(3)}{sep}{d(4)}", lambda: f"{plus}{cc}{sep}{d(2)}{sep}{d(r.randint(3, 5))}{sep}{d(3)}", lambda: f"{plus}{cc} {d(1)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", lambda: f"{plus}{cc} ({d(r.randint(2, 3))}) {d(3)}{sep}{d(4)}", lambda: f"{plus}{cc} (0){d(2)} {d(7)}", lambda: f"{plus}{cc}{d(r.randint(8, 10))}", lambda: f"{plus}{cc} {d(4)} {d(6)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)} {d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"(0{d(2)}) {d(4)} {d(4)}",
                lambda: f"0{d(3)}/{d(6)}", lambda: f"0{d(4)}-{d(5)}", lambda: f"0{d(1)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}", lambda: f"0{d(2)}.{d(4)}.{d(3)}", lambda: f"555-{d(4)}", lambda: f"{d(3)}-{d(4)}", lambda: f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"{plus}{cc}.{d(3)}.{d(3)}.{d(4)} {r.choice(('x', 'ext. ', 'ext '))}{d(r.randint(2, 4))}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"{plus}{cc}-{d(1)}-{d(4)}-{d(4)}", lambda: f"0{d(9)}",
            ]
        )()

    def national(self) -> tuple[str, str]:
        """(words before, number)"""
        r, d = self.r, self.digits
        upper = lambda n: "".join(r.choice(string.ascii_uppercase) for _ in range(n))
        number = r.choice(
            [
                lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{d(3)} {d(2)} {d(4)}", lambda: d(9), lambda: d(r.randint(8, 12)), lambda: f"{upper(2)} {d(2)} {d(2)} {d(2)} {upper(1)}", lambda: f"{upper(2)}{d(6)}{upper(1)}", lambda: f"{upper(1)}{d(r.randint(7, 8))}", lambda: f"{upper(1)}{d(8)}{upper(1)}", lambda: f"{d(8)}{upper(1)}", lambda: f"{d(8)}-{upper(1)}", lambda: f"{upper(2)}{d(7)}", lambda: f"{d(2)} {d(3)} {d(3)} {d(3)}", lambda: f"{d(2)}/{d(3)}/{d(5)}", lambda: f"{d(3)}/{d(4)}/{d(4)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"{d(4)}-{d(4)}-{d(4)}",
                lambda: f"{d(1)} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)}", lambda: f"{d(1)} {d(2)} {d(2)} {d(3)} {d(3)}", lambda: f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", lambda: f"{d(6)}-{d(4)}", lambda: f"{d(2)}-{d(7)}", lambda: f"756.{d(4)}.{d(4)}.{d(2)}", lambda: f"{upper(1)}{d(2)}{upper(2)}{d(4)}", lambda: f"{d(2)} {d(6)} {upper(1)} {d(3)}", lambda: f"{upper(6)}{d(2)}{upper(1)}{d(2)}{upper(1)}{d(3)}{upper(1)}",
            ]
        )()
        if sum(ch.isdigit() for ch in number) < 6:
            number = d(9)
        cue = r.choice(_ID_WORDS)
        if r.random() < 0.15:
            cue = cue.lower() if r.random() < 0.5 else cue.upper()
        return cue + r.choice([" ", " ", ": ", ":", " = ", " no. ", " nr ", " #", " is ", " (", ", "]), number

    def place(self) -> str:
        r = self.r
        s = self.syllables(1, 2).capitalize() + r.choice(["", "", "ton", "ville", "burg", "berg", "ford", "stadt", "heim", "o", "a", "mouth", "field"])
        return r.choice([s, s, s, s, f"{r.choice('New North Port Saint Bad Sankt Mont Nieder Ober Villa Great Upper San La'.split())} {s}", f"{s}-{self.syllables(1, 2).capitalize()}", f"{s} {r.choice('Bay Falls Heights City Hill am See sur Mer'.split())}"])

    def street(self) -> str:
        r, d = self.r, self.digits
        n = str(r.randint(1, 400)) + (r.choice("abcA") if r.random() < 0.08 else "")
        z = d(r.choice((4, 5, 5, 5)))
        if r.random() < 0.15:
            z = "".join(r.choice(string.ascii_uppercase) for _ in range(2)) + f"{d(1)} {d(1)}" + "".join(r.choice(string.ascii_uppercase) for _ in range(2))
        c = self.place()
        own = r.choice([lambda: r.choice(_STREET_COMMON), self.cap, lambda: self.syllables(1, 2).capitalize() + r.choice(["", "ton", "wood", "field", ""]), lambda: f"{self.cap()} {self.cap()}", self.family])()
        kind = r.choice(_STREET_KIND)
        tail = r.choice(["", "", f", {c}", f", {c}", f", {c} {z}", f", {z} {c}", f", {c}, {z}", f" in {c}"]).replace(" in ", ", ")
        flat = f"{r.choice(('Flat', 'Unit', 'Apt', 'Suite', 'Apartment', 'No.', 'Room'))} {r.randint(1, 60)}"
        stem = own.split()[0]
        return r.choice(
            [
                lambda: f"{n} {own} {kind}{tail}", lambda: f"{n} {own} {kind}{tail}", lambda: f"{n} {own} {kind}{tail}", lambda: f"{flat}, {n} {own} {kind}{tail}", lambda: f"{n} {own} {kind}, {flat}{tail}", lambda: f"{n}, {own} {kind}{tail}",
                lambda: f"{stem}{r.choice(('straße', 'strasse', 'weg', 'gasse', 'allee', 'platz', 'str.', 'ring', 'damm', 'ufer'))} {n}{tail}", lambda: f"{own.replace(' ', '-')}-{r.choice(('Straße', 'Strasse', 'Weg', 'Allee', 'Platz', 'Str.'))} {n}{tail}", lambda: f"{r.choice(('Am', 'An der', 'Zum', 'Im', 'Auf dem'))} {stem} {n}{tail}", lambda: f"{n}{r.choice((', ', ' '))}{r.choice(('rue', 'avenue', 'place', 'boulevard', 'chemin', 'quai', 'impasse', 'allée', 'Rue'))} {r.choice(('', 'de ', 'du ', 'de la ', 'des '))}{stem}{r.choice(('', '', 's'))}{tail}",
                lambda: f"{r.choice(('Calle', 'Avenida', 'Plaza', 'Paseo', 'C/', 'Carrera', 'Camino'))} {r.choice(('', 'de ', 'del ', 'de la '))}{own} {n}{tail}", lambda: f"{r.choice(('Via', 'Viale', 'Piazza', 'Corso', 'Largo'))} {r.choice(('', 'della ', 'del ', 'dei '))}{own}{r.choice((' ', ', '))}{n}{tail}", lambda: f"{stem}{r.choice(('gatan', 'vägen', 'gade', 'vej', 'straat', 'laan', 'gracht'))} {n}{tail}", lambda: f"{r.choice(('ul.', 'ulica', 'Rua', 'Praça'))} {own} {n}{tail}",
            ]
        )()

    def item(self) -> list[tuple[str, str | None]]:
        """Pieces of a sentence with at least one item: (text, kind or None)."""
        r, w = self.r, self.w
        kind = r.choices(("name", "email", "phone", "national_id", "street_address", "trailer"), (34, 22, 14, 13, 14, 10))[0]
        if kind == "trailer":
            t, who = self.name()
            a, b = r.choice([(" <", ">"), (" <", ">"), (" (", ")"), (", ", ""), (" ", "")])
            return [(f"{r.choice(_TRAILERS)}: ", None), (t, "name"), (a, None), (self.email(who), "email"), (b, None)]
        before = self.phrase(r.randint(1, 4)) if r.random() < 0.8 else ""
        before = (before[:1].upper() + before[1:]) if r.random() < 0.7 else before
        after = self.phrase(r.randint(1, 4))
        if kind == "name":
            t = self.name()[0]
            a = r.choice([f"{self.cap()} {r.choice('by with from for to via per and of as'.split())} ", f"{before} {r.choice('by with from for to via per and of as who on'.split())} ", f"{self.cap()}: ", f"{r.choice('Thanks As Per With By From Ask Via CC cc Owner Author Contact Dear Hi For And'.split())} ", "", "", f"{before} ", f"@{w()}, ", f"{self.cap()}-{w()}: ", f"({w()} "])
            b = r.choice([f" {after}.", f", {after}.", ".", "", f" {after}", ",", "'s " + after, f" ({after})", f"; {after}", ")", f" and {r.choice(_GIVEN)} {w()}", f": {after}"])
            return [(a, None), (t, "name"), (b, None)]
        if kind == "email":
            t = self.email()
            a, b = r.choice([(f"{before} ", f" {after}."), (f"{before} ", "."), (f"{before} (", f") {after}"), (f"{before} <", ">"), (f"{self.cap()}: ", ""), ("", f" {after}"), (f"{before} mailto:", f" {after}."), (f"{self.cap()} mailto:", "."), (f"{before}: ", f", {after}"), (f"{self.cap()} ", ","), ('"', '"'), ("<mailto:", ">"), (f"{before}, ", "")])
            return [(a, None), (t, "email"), (b, None)]
        if kind == "phone":
            t = self.phone()
            cue = r.choice(_PHONE_WORDS)
            sure = t[0] in "+＋(" or "x" in t
            a = r.choice([f"{before} {cue} ", f"{cue} ", f"{cue}: ", f"{before} {r.choice('on at via to under'.split())} " if sure else f"{cue} {r.choice('is at on was us me back'.split())} ", f"{self.cap()} {cue} {w()} ", f"{before} ({cue} ", f"{before} " if sure else f"{cue} {self.phrase(2)} on "])
            b = r.choice([f" {after}.", ".", "", f", {after}", f" {after}", ")" if "(" in a else ",", f" ({after})", f" or {after}"])
            return [(a, None), (t, "phone"), (b, None)]
        if kind == "national_id":
            cue, t = self.national()
            a = r.choice([f"{before} {cue}", cue, cue, f"{before} ({cue}", f"{before}: {cue}", f"{before} {r.choice(('a', 'the', 'with', 'and', 'of', 'her', 'his'))} {cue}"])
            b = (")" if a.count("(") > a.count(")") else "") + r.choice([f" {after}.", ".", "", f", {after}", f" {after}", ";"])
            return [(a, None), (t, "national_id"), (b, None)]
        t = self.street()
        a, b = r.choice([(f"{before} {r.choice('at to in from near on is was used'.split())} ", "."), (f"{before} ", f" {after}."), (f"{self.cap()}: ", ""), (f'{before} "', f'" {after}'), ("", ""), (f"{before}: ", f", {after}"), (f"{before} (", ")"), (f"{self.cap()} {r.choice('at to for'.split())} ", f" {after}.")])
        return [(a, None), (t, "street_address"), (b, None)]

    def subject(self) -> str:
        r = self.r
        s = self.phrase(r.randint(2, 6))
        roll = r.random()
        if roll < 0.35:
            return f"{r.choice('fix feat docs test build chore perf refactor ci style revert'.split())}{r.choice(('', f'({self.w()})'))}: {s}"
        if roll < 0.55:
            return f"{self.w()}: {s}"
        return s[:1].upper() + s[1:] if roll < 0.85 else s

    def line(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A line and its labelled spans."""
        r = self.r
        pieces: list[tuple[str, str | None]] = []
        kind = r.random()
        if kind < 0.13:  # an address field
            roll = r.random()
            if roll < 0.75:
                pieces = [(self.email(), "email")]
            elif roll < 0.93:
                t, who = self.name()
                if r.random() < 0.2:
                    t = f'"{t}"'
                    pieces = [('"', None), (t[1:-1], "name"), ('" <', None), (self.email(who), "email"), (">", None)]
                else:
                    pieces = [(t, "name"), (" <", None), (self.email(who), "email"), (">", None)]
            else:
                pieces = [(r.choice(["(none)", "none", "", "unknown", "root", self.w(), f"{self.w()}@{self.w()}", f"<{self.w()}>"]), None)]
        elif kind < 0.45:
            pieces = [(self.subject(), None)]
            if r.random() < 0.4:
                a, z = r.choice([(" (", ")"), (" - ", ""), (", ", ""), (": ", "")])
                pieces += [(a, None), *self.item(), (z, None)]
        else:
            if r.random() < 0.1:
                pieces.append((r.choice(("- ", "* ", "> ", "    ", "# ", f"{r.randint(1, 9)}. ")), None))
            for k in range(r.choice((1, 1, 2, 3))):
                if k:
                    pieces.append((" ", None))
                pieces += self.item() if r.random() < 0.62 else [(self.sentence(), None)]
        text, spans = "", []
        for t, k in pieces:
            if k and t:
                spans.append((len(text), len(text) + len(t), k))
            text += t
        if r.random() < 0.05:
            text += "\r"
        return text[:400], [s for s in spans if s[1] <= 400]
