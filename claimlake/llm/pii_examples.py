"""Labelled examples of candidates, drawn from grammars of formats: no labelled personal data is given.

A grammar writes what people and programs write: numbers that follow a numbering plan and ones that do not, accounts
whose check digits hold and ones that fail, keys and look-alikes. Half of the examples stand without a telling word,
so that the format must decide.
"""

from __future__ import annotations

import random
import string

#: Words before a candidate, by what they tell: fixed values, shared with the features.
PERSON = ["call", "phone", "tel", "mobile", "cell", "fax", "contact", "reach", "whatsapp", "ssn", "social security", "tax id", "applicant", "iban", "account", "bank", "transfer", "mail", "write to", "telefon", "handy", "mobil", "ruf", "appel", "tél", "portable", "joindre", "llam", "móvil", "teléfono", "whats app", "hotline", "office", "dial", "ring"]
THING = ["order", "part", "serial", "isbn", "invoice", "version", "sum of", "value", "table", "row", "lot", "code", "ref", "batch", "product key", "licence", "license", "model", "between", "case", "score", "result", "rating", "room", "page", "chapter", "section", "article", "flight", "sku", "barcode", "catalog", "standard", "formula", "figure", "bestell", "rechnung", "facture", "commande", "pedido", "factura", "artikel", "seite"]
SECRET = ["token", "secret", "api key", "password", "passwd", "auth", "bearer", "credential"]
HASH = ["commit", "sha1", "sha256", "md5", "checksum", "etag", "hash", "digest", "uuid", "path", "url", "file"]
PLAIN = ["and then", "we saw", "the next", "it was", "with", "in the", "of", "un", "les", "der", "que", "send to", "or"]
AFTER = ["", ".", ",", " today", " and more", " please", ")", " est"]

Example = tuple[str, str, str, str, int]


def check_digits(body: str, country: str) -> str:
    """The two digits that make an account number hold modulo 97."""
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def word_(draw: random.Random) -> str:
    return "".join(draw.choices(string.ascii_lowercase, k=draw.randint(3, 9)))


class Grammar:
    def __init__(self, seed: int):
        self.draw = random.Random(seed)

    def digits(self, n: int, first: str = string.digits) -> str:
        return self.draw.choice(first) + "".join(self.draw.choices(string.digits, k=n - 1)) if n else ""

    def before(self, *kinds: list[str]) -> str:
        words = self.draw.choice(kinds)
        return f"{self.draw.choice(PLAIN)} {self.draw.choice(words)}{self.draw.choice([' ', ': ', ' is ', ' no '] if words is not PLAIN else [' '])}"

    def phone(self) -> Example:
        good, sep = self.draw.random() < 0.5, self.draw.choice("---. ")
        a, b = self.digits(3, "23456789"), self.digits(3, "23456789")
        style = self.draw.randrange(5)
        if style == 0:
            found = f"({a}) {b}-{self.digits(4)}"
        elif style == 1:
            found = sep.join([a, b, self.digits(4)])
        elif style == 2:
            groups = [self.digits(self.draw.choice([2, 2, 3])) for _ in range(self.draw.randint(3, 4))]
            found = self.draw.choice([" ", ".", "-"]).join(["00" + self.digits(2, "123456789"), self.digits(1, "123456789"), *groups])
        elif style == 4:
            found = "0" + self.digits(self.draw.randint(2, 4), "123456789") + self.draw.choice(" /-") + self.digits(self.draw.randint(5, 8))
        else:
            groups = [self.digits(self.draw.choice([2, 2, 3, 4])) for _ in range(self.draw.randint(2, 4))]
            found = self.draw.choice([" ", "-", "/"]).join(["0" + self.digits(self.draw.randint(1, 3), "123456789"), *groups])
        if good:
            sure = style == 0 or (style == 1 and sep == "-") or style == 2
            return "phone", found, self.before(PERSON, PLAIN if sure else PERSON), self.draw.choice(AFTER), 1
        if self.draw.random() < 0.6:
            return "phone", found, self.before(THING), self.draw.choice(AFTER), 0
        odd = [" ".join([self.digits(3, "1"), self.digits(3, "0123"), self.digits(4)]), f"{self.draw.randint(1, 9)}00 {self.draw.randint(1, 9)}00 {self.draw.randint(1, 9)}000", sep.join([self.digits(3, "01"), self.digits(3, "01"), self.digits(4)])]
        spaced = " ".join([a, b, self.digits(4)])
        if self.draw.random() < 0.3:
            return "phone", self.draw.choice([found, spaced]), f"{self.before(PLAIN, PERSON)}{self.digits(4)} ", self.draw.choice([*AFTER, " " + self.digits(2)]), 0
        if self.draw.random() < 0.4:
            return "phone", spaced, "| " + self.digits(2) + " | ", " | " + self.digits(2), 0
        return "phone", self.draw.choice(odd), self.before(PLAIN, THING), self.draw.choice([*AFTER, " " + self.digits(3)]), 0

    def ssn(self) -> Example:
        area = f"{self.draw.randint(1, 899):03d}"
        good = self.draw.random() < 0.5 and area != "666"
        if good:
            return "ssn", f"{area}-{self.draw.randint(1, 99):02d}-{self.draw.randint(1, 9999):04d}", self.before(PERSON, PLAIN), self.draw.choice(AFTER), 1
        bad = self.draw.choice([f"{self.draw.choice(['000', '666', '9' + self.digits(2)])}-{self.digits(2, '123456789')}-{self.digits(4)}", f"{area}-00-{self.digits(4)}", f"{area}-{self.digits(2, '123456789')}-0000"])
        if self.draw.random() < 0.6:
            return "ssn", f"{area}-{self.digits(2, '123456789')}-{self.digits(4, '123456789')}", self.before(THING), self.draw.choice(AFTER), 0
        return "ssn", bad, self.before(PLAIN, PERSON, THING), self.draw.choice(AFTER), 0

    def iban(self) -> Example:
        country, good = self.draw.choice(["DE", "GB", "FR", "ES", "IT", "NL", "AT", "CH", "PT"]), self.draw.random() < 0.5
        body = "".join(self.draw.choice(["", *string.ascii_uppercase[:6]]) for _ in range(self.draw.choice([0, 0, 4]))) + self.digits(self.draw.randint(14, 18))
        check = check_digits(body, country) if good else f"{(int(check_digits(body, country)) + self.draw.randint(1, 90)) % 97:02d}"
        plain = country + check + body
        if not good and self.draw.random() < 0.5:
            plain = "".join(self.draw.choices(string.ascii_uppercase, k=2)) + self.digits(2) + "".join(self.draw.choices(string.ascii_uppercase + string.digits, k=16))
        plain = plain[: len(plain) - len(plain) % 4] if not good else plain
        found = " ".join(plain[i : i + 4] for i in range(0, len(plain), 4)) if self.draw.random() < 0.5 else plain
        return "iban", found, self.before(PERSON, PLAIN, THING), self.draw.choice(AFTER), int(good)

    def email(self) -> Example:
        word = lambda low, high: "".join(self.draw.choices(string.ascii_lowercase, k=self.draw.randint(low, high)))
        style = self.draw.choice([("(at)", "(dot)"), ("[at]", "[dot]"), ("[AT]", "[DOT]"), ("(at)", "(dot)")])
        gap = self.draw.choice(["", " "])
        good = self.draw.random() < 0.6
        last = self.draw.choice(["com", "org", "net", "de", "fr", "io", "info"]) if good else self.draw.choice([word(8, 14), self.digits(2), word(4, 8) + self.digits(2)])
        if self.draw.random() < 0.3:
            return "email", gap.join([word(2, 9), style[0], word(3, 10) + "." + last]), self.before(PLAIN, PERSON), self.draw.choice(AFTER), int(good)
        parts = [word(2, 9), style[0], word(3, 10), *([style[1], word(3, 8)] if self.draw.random() < 0.3 else []), style[1], last]
        return "email", gap.join(parts), self.before(PLAIN, PERSON), self.draw.choice(AFTER), int(good)

    def secret(self) -> Example:
        hexed = lambda n: "".join(self.draw.choices("0123456789abcdef", k=n))
        mixed = lambda n: "".join(self.draw.choices(string.ascii_letters + string.digits, k=n))
        assign, quote = self.draw.choice([" = ", "=", ": ", " : "]), self.draw.choice(['"', "'", ""])
        roll = self.draw.random()
        if roll < 0.08:
            return "secret", f"-----BEGIN {self.draw.choice(['', 'RSA ', 'EC ', 'OPENSSH '])}PRIVATE KEY-----", self.before(PLAIN), self.draw.choice(AFTER), 1
        if roll < 0.13:
            return "secret", ".".join(["eyJ" + mixed(self.draw.randint(12, 40)), *(mixed(self.draw.randint(12, 60)) for _ in range(self.draw.randint(1, 2)))]), self.before(PLAIN, SECRET), self.draw.choice(AFTER), 1
        if roll < 0.16:
            return "secret", self.draw.choice([hexed(32), hexed(40), mixed(self.draw.randint(20, 40))]), f"{self.draw.choice(PLAIN)} https://{word_(self.draw)}.org/", self.draw.choice(["/x", ".html", "", "?q=1"]), 0
        if roll < 0.3:
            value = self.draw.choice([hexed(32), hexed(40), hexed(64), mixed(self.draw.randint(20, 64)), "ghp_" + mixed(36), "AKIA" + "".join(self.draw.choices(string.ascii_uppercase + string.digits, k=16)), "sk-" + mixed(40)])
            return "secret", value, f"{self.draw.choice(PLAIN)} {self.draw.choice([*SECRET, 'key', 'x', 'cfg'])}{assign}{quote}", quote + self.draw.choice(AFTER), 1
        if roll < 0.5:
            value = self.draw.choice([hexed(24), mixed(self.draw.randint(10, 30)), mixed(8) + "!" + self.digits(2)])
            name = self.draw.choice(["password", "passwd", "pwd", "secret", "token", "api_key", "api-key", "apikey"])
            return "secret", f"{name}{assign}{quote}{value}{quote}", self.before(PLAIN), self.draw.choice(AFTER), 1
        word = lambda: "".join(self.draw.choices("etaoinshrdlu", k=self.draw.randint(3, 9)))
        if roll < 0.62:
            return "secret", f"{self.draw.choice(['password', 'secret', 'token'])}: {word()}{word()}", self.before(PLAIN), self.draw.choice(AFTER), 0
        if roll < 0.75:
            return "secret", self.draw.choice([hexed(32), hexed(40), hexed(64)]), self.before(HASH), self.draw.choice(AFTER), 0
        kinds = ["_".join(word() for _ in range(4)), "-".join(word() for _ in range(5)), "/".join([word(), word(), word(), self.digits(3), word()]), "x" * 24, self.digits(24), "=" * 30, "-" * 30, word() + word() + word() + word(), "_".join([word(), word(), word(), self.digits(2)])]
        value = self.draw.choice([k for k in kinds if len(k) >= 20] or ["-" * 24])
        return "secret", value, self.draw.choice([self.before(PLAIN), self.before(HASH), "name = ", "href=" + quote]), self.draw.choice(AFTER), 0

    def birth(self) -> Example:
        good, word = self.draw.random() < 0.6, self.draw.choice(["born", "born on", "dob", "date of birth", "geboren am", "née le", "nacido el"])
        year = self.draw.randint(1920, 2015) if good else self.draw.choice([self.draw.randint(2030, 2099), self.draw.randint(1900, 2015)])
        day, month = self.draw.randint(1, 28), self.draw.randint(1, 12)
        if not good and year < 2030:
            day, month = self.draw.randint(32, 99), self.draw.randint(13, 99)
        sep = self.draw.choice("./-")
        date = f"{year}-{month:02d}-{day:02d}" if self.draw.random() < 0.3 else f"{day:02d}{sep}{month:02d}{sep}{year}"
        return "birth", f"{word}{self.draw.choice([' ', ': '])}{date}", self.before(PLAIN), self.draw.choice(AFTER), int(good)


def examples(seed: int = 1, each: int = 500) -> list[Example]:
    """(kind, found, before, after, label): so many of every kind."""
    grammar = Grammar(seed)
    return [getattr(grammar, kind)() for kind in ("phone", "ssn", "iban", "email", "secret", "birth") for _ in range(each)]
