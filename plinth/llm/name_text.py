"""Names and addresses of one identity: cleaning, parts, and what an address says about a name."""

from __future__ import annotations

import re
import unicodedata

#: Authors that stand for nobody.
NOBODY = frozenset(
    "|none|(none)|null|nil|n/a|na|unknown|root|dev|user|admin|administrator|anonymous|anon|nobody|noname|no name|no author|(no author)|your name|name|author|test|tester|default|ubuntu|debian|localhost|git|github|you|me|guest|student|developer|system|unset|todo|changeme|example|placeholder|first last|firstname lastname|john doe|jane doe|undefined|-|.|?".split("|")
)
#: Local parts of addresses that belong to a role, not a person.
ROLES = frozenset("noreply no-reply donotreply do-not-reply root admin administrator build builds builder ci cd bot bots info support help contact dev devs developers team ops sysadmin webmaster postmaster hostmaster mail office security git svn jenkins nobody none you user test tests release releases automation maintainers maintainer git-commits commits service services daemon www web default me".split())
_PLACEHOLDER_DOMAIN = re.compile(r"(?:^|\.)(?:placeholder|workstation|localhost|localdomain|local|none|unknown|example\.com|example\.org)(?:\.|$)")
#: Given names and short forms in common use that are not just their beginnings.
NICKNAMES = {
    "abigail": "gail", "agnieszka": "aga", "albert": "bert bertie", "aleksandra": "ola", "alexander": "sandy sasha xander lex", "alexandra": "sandra sasha", "alfred": "fred", "anastasia": "nastya stacy", "andrew": "drew", "anthony": "tony", "antonio": "toni tonio", "barbara": "babs basia", "benjamin": "benny", "bernard": "bernie", "bridget": "biddy", "catherine": "kate katie cathy kitty kit", "charles": "charlie chuck chaz",
    "charlotte": "lottie lotte", "christina": "tina", "christopher": "kit topher", "deborah": "debbie", "dmitry": "dima mitya", "dorothy": "dot dottie dolly", "edmund": "ned ted", "edward": "ned ted teddy eddie", "eleanor": "nell nora ellie", "elisabeth": "liz lisa lizzie beth betty elsa", "elizabeth": "liz lisa lizzie beth betty bess", "evgeny": "zhenya", "ferdinand": "nando", "florence": "flossie", "francesco": "checco", "francisco": "paco pancho cisco", "frederick": "fritz rick freddie",
    "friedrich": "fritz", "gerald": "jerry", "gertrude": "trudy", "giovanni": "gianni", "giuseppe": "beppe pino", "guillermo": "memo", "hannelore": "lore", "harold": "hal harry", "heinrich": "heinz heiner", "helen": "nell nellie", "henrietta": "hattie etta", "henry": "harry hank hal", "ignacio": "nacho", "isabella": "bella izzy", "jacqueline": "jackie", "james": "jim jimmy jamie", "janusz": "januszek", "jesus": "chucho", "johannes": "hans hannes", "john": "jack johnny", "jonathan": "jon johnny nathan",
    "jose": "pepe", "josef": "sepp", "joseph": "joe joey", "josephine": "josie", "juergen": "jogi", "katarzyna": "kasia", "katherine": "kate katie kathy kitty", "konstantin": "kostya", "lawrence": "larry laurie", "leonard": "len lenny", "louise": "lulu", "lucille": "lucy", "luis": "lucho", "magdalena": "lena", "malgorzata": "gosia", "margaret": "maggie meg peggy greta madge daisy", "maria": "mia mitzi", "martha": "marty patsy", "mary": "molly polly mamie", "matilda": "tilly", "matthew": "matty",
    "mercedes": "merche", "michael": "mike mick mickey misha", "mikhail": "misha", "mildred": "millie", "natalia": "talia", "nathaniel": "nate nat", "nicholas": "nick nicky klaus", "nikolai": "kolya", "nikolaos": "nikos", "norman": "norm", "oliver": "ollie", "patricia": "pat patty trish tricia", "patrick": "paddy", "penelope": "penny", "philippa": "pippa", "pilar": "pili", "raymond": "ray", "rebecca": "becky", "reginald": "reggie", "richard": "dick rick richie", "robert": "bob bobby rob bert",
    "roberto": "beto", "rodrigo": "rigo", "ronald": "ronnie", "rosemary": "rosie", "samantha": "sam sammy", "samuel": "sammy", "sarah": "sally", "sebastian": "bastian basti", "sergei": "seryozha", "sofia": "sonya", "stanislaw": "staszek", "stephanie": "steph steffi", "stephen": "steve", "susan": "sue suzie", "susanne": "susi", "tatiana": "tanya", "theodore": "ted teddy", "theresa": "terry tess", "thomas": "tom tommy", "timothy": "timmy", "valentina": "tina", "victoria": "vicky tori", "vincenzo": "enzo",
    "virginia": "ginny", "vladimir": "volodya vova", "walter": "wally", "wilhelm": "willi", "william": "bill billy liam willy", "wolfgang": "wolfi", "yevgeny": "zhenya", "zachary": "zack",
}

_LETTERS = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "þ": "th", "ð": "d", "ı": "i", "’": "'", "–": "-", "—": "-"})
_NOTE = re.compile(r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}|<[^>]*>|\s+-\s+.*$|\s+(?:via|on behalf of)\s.*$|\s+at\s+work$", re.IGNORECASE)
_TITLES = frozenset("phd md msc bsc mba dr prof mr mrs ms miss sir jr sr ii iii iv esq ing dipl mag ext".split())
_SHORT_ROLES = {"maint": "maintainers", "grp": "group", "tm": "team", "gld": "guild", "maintainer": "maintainers"}
_TEAM = frozenset("group team guild maintainers bot crew committee project foundation collective developers".split())


def repaired(text: str) -> str:
    """Undoes UTF-8 that was read as Latin-1 or Windows-1252."""
    if any(ch in text for ch in "ÃÅÄÂâ"):
        for codec in ("latin-1", "cp1252"):
            try:
                return text.encode(codec).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return text


def ascii_letters(text: str) -> str:
    t = unicodedata.normalize("NFKD", repaired(text).translate(_LETTERS))
    return "".join(ch for ch in t if not unicodedata.combining(ch))


def name_tokens(name: str | None) -> list[str]:
    """Lower-case words of a name in the order given-names, family name; titles and notes are dropped."""
    if name is None:
        return []
    n = ascii_letters(name).strip()
    bot = re.search(r"\[bot\]$", n, re.IGNORECASE) is not None
    n = re.sub(r"(?i),?\s+(?:jr|sr|ii|iii|phd|md|msc|esq)\.?$", "", n)
    n = _NOTE.sub(" ", n)
    if " " not in n.strip() and re.search(r"[a-z][A-Z]", n):
        n = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", n)
    if n.count(",") == 1:
        a, b = n.split(",")
        n = f"{b} {a}"
    words = [w for w in re.split(r"[^a-z0-9]+", n.lower()) if w and w not in _TITLES and w != "the"]
    words = [_SHORT_ROLES.get(w, w) for w in words]
    if bot:
        words.append("bot")
    return words


def email(address: str | None) -> tuple[str, str] | None:
    """(local part without tag, domain), both lower-case; None if there is no address."""
    if address is None:
        return None
    a = ascii_letters(address).strip().lower()
    m = re.search(r"<([^<>]+)>\s*$", a)
    if m:
        a = m[1].strip()
    a = re.sub(r"^mailto:", "", a)
    a = re.sub(r"\s*(?:[\[({<]\s*at\s*[\])}>]|\sat\s|\(a\))\s*", "@", a)
    a = re.sub(r"\s*(?:[\[({<]\s*dot\s*[\])}>]|\sdot\s)\s*", ".", a)
    a = re.sub(r"\s+", "", a).strip("<>\"'.,;")
    if a.count("@") != 1:
        return None
    local, domain = a.split("@")
    if not local or not domain or _PLACEHOLDER_DOMAIN.search(domain):
        return None
    m = re.fullmatch(r"(\d+)\+([\w\-.]+)", local)
    if not m and "+" in local:
        local = local.split("+")[0]
    return (local, domain) if local else None


def nobody(name: str | None) -> bool:
    return name is None or ascii_letters(name).strip().lower() in NOBODY


def role(local: str) -> bool:
    return local.rstrip("0123456789") in ROLES


def close(a: str, b: str) -> bool:
    """Whether one edit (insert, delete, replace, swap of neighbours) or none leads from a to b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


class Identity:
    """What one (name, address) pair says.

    keys: things that, if equal, make two identities one.  full: (given, family) or None.  initial:
    (letter, family) still to be completed.  ``given``: tokens known as given names.
    """

    __slots__ = ("domain", "fam", "email", "from_mail", "full", "initial", "keys", "loose", "org")

    def __init__(self, name: str | None, address: str | None, given: frozenset[str] = frozenset()) -> None:
        self.keys: set[str] = set()
        self.full: tuple[str, str] | None = None
        self.initial: tuple[str, str] | None = None
        self.from_mail: tuple[str, str] | None = None
        self.loose: list[tuple[str, str]] = []  # (letter, family) readings of a login
        self.org: str | None = None
        self.email: str | None = None
        self.fam: str | None = None  # the family name, as the address spells it if it does
        mail = email(address)
        words = [] if nobody(name) else name_tokens(name)
        long = [w for w in words if len(w) > 1]
        local, self.domain = mail if mail else (None, None)
        label = None
        if mail:
            parts = self.domain.split(".")
            label = parts[-2] if len(parts) > 1 else parts[0]
        if words and label and any(close(w, label) and len(w) > 3 for w in words):
            self.org = label
            self.keys.add(f"O:{label}")
            self.keys.add("W:" + " ".join(sorted(long)))
            return
        if any(w in _TEAM for w in words):
            self.keys.add("W:" + " ".join(sorted(long)))
            return
        if mail and role(local):
            mail, local = None, None
        forge = re.fullmatch(r"(\d+)\+([\w\-.]+)", local) if mail else None
        if mail and not nobody(name):
            self.email = f"{local}@{self.domain}"
        if mail and name is None:
            self.email = f"{local}@{self.domain}"
        if mail and not forge and re.fullmatch(r"[a-z]{4,}\d+", local):
            self.keys.add(f"H:{local}")
        login = None
        if len(words) == 1 and re.fullmatch(r"[a-z]+\d+", words[0]):
            self.keys.add(f"H:{words[0]}")
        elif len(words) == 1:
            login = words[0]
        elif len(long) >= 2:
            self.full = (long[0], long[-1])
            if long[-1] in given and long[0] not in given:  # family name first
                self.full = (long[-1], long[0])
        elif len(words) >= 2 and len(long) == 1:
            self.initial = (next(w for w in words if len(w) == 1), long[0])
        # What the address says.
        if mail and not forge:
            bits = [b for b in re.split(r"[._\-]", local) if b]
            if len(bits) == 2 and all(len(b) > 1 and b.isalpha() for b in bits):
                self.from_mail = (bits[0], bits[1])
        if self.full and self.from_mail:
            g, f = self.full
            a, b = self.from_mail
            if close(a, g) or close(b, f):
                pass
            elif close(b, g) or close(a, f):
                self.from_mail = (b, a)
            else:
                self.from_mail = None
        elif self.initial and self.from_mail:
            a, b = self.from_mail
            letter, f = self.initial
            self.from_mail = (a, b) if close(b, f) and a[0] == letter else (b, a) if close(a, f) and b[0] == letter else None
        elif login and self.from_mail:
            a, b = self.from_mail
            self.from_mail = (a, b) if login in (a[0] + b, b + a[0], a + b) else (b, a) if login in (b[0] + a, a + b[0], b + a) else None
        elif not words and name is None and self.from_mail:
            pass
        elif self.from_mail and not (len(words) == 1 and words[0][-1].isdigit()):
            self.from_mail = None
        if self.from_mail and len(words) == 1 and words[0][-1].isdigit():
            stem = words[0].rstrip("0123456789")
            a, b = self.from_mail
            self.from_mail = (a, b) if stem == b[:4] + a[:2] else (b, a) if stem == a[:4] + b[:2] else None
        if self.full and mail and not self.from_mail:
            # gfamily, familyg or a forge login: the spelling of the family name the account has.
            g, f = self.full
            stem = (forge[2] if forge else local).rstrip("0123456789")
            for fam in {stem, stem[1:], stem[:-1]}:
                if len(fam) > 4 and fam != f and close(fam, f):
                    self.loose.append((g[0], fam))
        known = self.from_mail or self.full or self.initial
        self.fam = known[1] if known else None
        if self.full and self.loose:
            self.fam = self.loose[0][1]
        if login:
            if len(login) > 4:
                self.loose += [(login[0], login[1:]), (login[-1], login[:-1])]
        for full in (self.full, self.from_mail):
            if full:
                self.keys.add("W:" + " ".join(sorted(full)))
        if login and not self.from_mail and not self.email:
            self.keys.add(f"L:{login}")
