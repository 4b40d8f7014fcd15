"""The labelled table of the personal-data field: lines in which [kind text] marks a span.

Each template stands for lines of one wording; its slots are filled with invented values by a fixed random sequence. None is a person's data.
"""

from __future__ import annotations

import random
import string

#: {slot} outside of brackets is a value that is no personal data.
TEMPLATES = [
    # Telephone numbers without a plus sign.
    "call me at [phone {phone}] after noon", "tel [phone {phone}] or write", "phone: [phone {phone}]", "mobile [phone {phone}] please", "fax [phone {phone}] office",
    "reach us on [phone {phone}] all day", "ring [phone {phone}] now", "telephone number [phone {phone}]", "my cell is [phone {phone}] and I am home", "text [phone {phone}] today",
    "WhatsApp [phone {phone}]", "contact number: [phone {phone}]", "dial [phone {phone}] for the front desk", "Tel. [phone {phone}] oder schreiben", "tél : [phone {phone}] merci", "teléfono [phone {phone}] gracias",
    # Addresses of mail that the pattern misses.
    "write to [email {user}@localhost] for help", "contact [email {user}@intranet] first", "mail [email {user} at example dot com] please", "reach me: [email {user} at {word} dot org]",
    "my e-mail is [email {user} at {word} dot net]", "send it to [email {user} (at) {word} (dot) com]",
    # Secrets.
    "password: [secret {password}]", "the password is [secret {password}]", "passwd=[secret {password}] in the file", "pwd [secret {password}] works", "api_key = [secret {key}]",
    "API key: [secret {key}]", "apikey '[secret {key}]' found", "secret: [secret {key}]", "client_secret=[secret {key}]", "Authorization: Bearer [secret {key}]", "access token [secret {key}] expires soon",
    "export AWS_SECRET_ACCESS_KEY=[secret {key}]", "aws key [secret AKIA{upper16}]", "use [secret sk-{alnum32}] for the service", "it was [secret ghp_{alnum36}] in the log", "login with password [secret {password}] please",
    "auth_token: [secret {key}]", "private_key = '[secret {key}]'", "credentials are admin and [secret {password}]", "PASSWORD=[secret {password}]", "session token is [secret {key}]", "slack [secret xoxb-{digits11}-{alnum20}]", "secret_key := \"[secret {key}]\"",
    "my pin is [secret {digits4}] for the door", "Kennwort: [secret {password}]", "mot de passe : [secret {password}]", "contraseña: [secret {password}]", "bearer [secret eyJ{alnum32}.{alnum36}]", "token: [secret {hex32}]", "token [secret {hex64}]", "key = \"[secret {hex40}]\"",
    '"secret": "[secret {key}]",', '"access_token": "[secret {key}]"', "auth='[secret {key}]' in the settings", "{word}_secret = '[secret {key}]'", '{word}_token="[secret {key}]" {word}', 'set password = "[secret {password}]" {word}',
    # National ids.
    "SSN [id {ssn}] on file", "social security number: [id {ssn}]", "my ssn is [id {ssn}]", "passport [id {letter}{digits8}] issued", "passport no. [id {upper2}{digits7}]", "national insurance [id {upper2}{digits6}{letter}]",
    "tax id [id {digits2}-{digits7}]", "id card number [id {digits9}]", "driver's licence [id {letter}{digits7}]", "the applicant, [id {ssn}], signed", "Steuer-ID [id {digits11}]", "DNI [id {digits8}{letter}]", "patient id [id {digits8}]",
    # Accounts.
    "IBAN [iban {iban}] please", "pay to [iban {iban}] today", "account [iban {iban4}] at the bank", "Konto: [iban {iban4}]", "transfer to IBAN: [iban {iban4}]", "iban = [iban {iban}]", "account number [iban {digits10}] sort code [iban {digits2}-{digits2}-{digits2}]",
    # Names by their context.
    "my name is [name {first} {last}] and I work here", "Mr. [name {last}] called", "Mrs [name {first} {last}] will answer", "Dr. [name {first} {last}] signed", "name: [name {first} {last}]", "Dear [name {first}],", "Yours sincerely, [name {first} {last}]",
    "signed by [name {first} {last}] today", "contact [name {first} {last}] at the office", "patient [name {first} {last}] was seen", "I am called [name {first} {last}]", "Ms [name {last}] has left", "Herr [name {last}] ist da", "Madame [name {last}] est ici", "customer: [name {first} {last}]",
    # Addresses.
    "I live at [address {digits2} {last} Street] near the park", "address: [address {digits3} {last} Avenue]", "ship to [address {digits3} {last} Road], please", "she moved to [address {digits2} {last} Lane]", "home address [address {digits3} {last} St]",
    "wohnt in der [address {last}straße {digits2}]", "address: [address {digits2} rue {last}]", "residing at [address {digits3} North {last} Boulevard]",
    # Dates of birth.
    "born on [birth {date}] in town", "date of birth: [birth {date}]", "DOB [birth {date}]", "dob: [birth {date}]", "geboren am [birth {date}]", "né le [birth {date}]", "birthday [birth {date}] is near",
    "born [birth {daymonth}] in the north", "she was born on [birth {daymonth}]", "date of birth [birth {daymonth}]", "DOB: [birth {daymonth}]", "né le [birth {daymonth}] à la ville", "geboren am [birth {daymonth}]",
    "lives at [address {digits3}{letter} {last} Street]", "at [address {digits2}{letter} {last} Road] since {year}", "my address is [address {digits2} {last} Avenue]", "Call [phone {phone}]", "call [phone {phone}] today", "[phone {phone}] is my number",
    "Meet [name {first} {last}] there", "with regards, [name {first} {last}]", "write to [email {user} (at) {word} (dot) org] today", "[email {user} (at) {word} (dot) com]", "account [iban {iban4}]", "[iban {iban4}] is the IBAN",
    # In long texts.
    "{prose20} call [phone {phone}] {prose20}", "{prose20} my name is [name {first} {last}] and {prose20}", "{prose30} password: [secret {password}] {prose20}", "{prose20} write to [email {user} at {word} dot org] {prose20}", "{prose20} IBAN [iban {iban}] {prose10}",
    "{prose20} born on [birth {daymonth}] {prose20}", "{prose10} I live at [address {digits2} {last} Street] {prose30}", "{prose20} my ssn is [id {ssn}] {prose10}", "{prose20} api_key = [secret {key}] {prose20}", "{prose20} client_secret = \"[secret {key}]\" {prose20}", "{prose20} the token is [secret {key}] {prose20}", "{prose20} token: [secret {key}] {prose20}", "{prose10} secret_key = \"[secret {hex40}]\" {prose10}", "{prose20} {word}_key = '[secret {key}]' {prose20}",
    # Several at once.
    "name: [name {first} {last}], phone: [phone {phone}], SSN [id {ssn}]", "[name {first} {last}], [address {digits2} {last} Street], born [birth {date}]", "user {word} password [secret {password}] phone [phone {phone}]",
    # Nothing personal.
    "in {year} the house was sold for 1,{digits3},{digits3} in cash", "version 2.{digit}. of the licence, see section 4.{digit}.2 for more", "under CC BY-NC 4.0. and the rest", "on {date} at 10:30 we met {digits2} people", "chapter {digit} has {digits3} pages and {digits2} plates",
    "the score was 3-2 and then 21-19, 6-4", "isbn 978-3-16-{digits6}-0 and price 19.99", "page 12 of {digits3}, item {digits7} in stock", "order {digits8} shipped {digit} boxes of 12", "figure 3.2.1 shows {digits2}% and 0.125 of it",
    "room {digits3}, floor 2, 1999-{year}", "user @home said hello @all 5 times", "h2o and co2 in b2b, mp3 and 4k", "id {uuid} was found", "pop. 1 {digits3} {digits3} in 2010 and 1 345 678 in 2020", "total 12.500,00 and 3.000 more", "12 34 56 78 are numbers",
    "serial {digits16} is on the box", "number {digits16} of the lot", "lot {digits16} {digits16} was sold", "{digits16} {word} {word}", "{word} {digits16} {word}", "commit {hex40} fixed it", "sha256 {hex64} of the archive", "md5 {hex32} of the file", "checksum: {hex40}",
    "the password is required to log in", "password must be long and secret", "enter your password and name", "the token economy of the village", "a key to the city, a secret garden", "keys and tokens are stored elsewhere", "secret: none of them knew it", "api key management is hard",
    "The Street was empty and the Road long", "Mr. and Mrs. came home", "name of the game", "call me later", "phone it in", "he was born in {year} and died in {year}", "{last} is a town on the river", "In {last} and {last} the rain fell", "they met {first} again in {last}",
    "address the problem at once", "account for the loss", "the patient waited", "dear reader, look at this", "see {url} for details", "at {digits2} dot the line crosses", "we dot the i at noon", "{word} {word} {word} {word}", "{Word} {word} {word}, {Word} {word}.",
    "{word} | {word} | {word}", "{Word} {word}: {word} {word}; {word}", "{word} {digits3} {word} {digits5}", "{digits5} {word}", "{Word} {Word} {word} {digits4}", "if (x[{digit}] == {digits2}) return y{digit};", "def f{digit}(a, b): return a + {digits2}", "{word}-{word} {word}_{word}", "{Word} {word} {word}. {Word} {word} {word}, {word} {Word}. {Word}.", "{word} {word}, {word} {word}. {Word} {Word} {word} {word}.", "{CAPS} {CAPS}!! {CAPS} {CAPS} {CAPS}!", "{word}### {word}$$$ {word}%%% {word}",
    "{Word} {word} {word} {word} {word} {word} {word} {word} {word} {word} {word} {word}.", "# {Word} {word}", "At At At At At At At At At", "no no no no no no no", "de de de de de de de de", "the the the the of of of of", "{word}. {word}, {word} in, and of. The", "{word} by. {Word}. {Word} {word}", "{word} is. {Word} {word} was. {Word}", "{word} the {word} of {word} at {word}", "the {word} and {word} to {word} by {Word}", "de la {word} und der {word}", "{word} st {word}. {Word} {word} dot",
    "tracking 1Z{alnum16} arrived", "flight {upper2}{digits3} at gate B{digits2}", "model {upper2}-{digits4}X in black", "zip {digits5} and area {digits3}", "{digits10} views in {digits2} days", "timestamp {digits10} and {digits13}", "ratio 3:{digit}, 10:{digits2}", "token count {digits5}", "key {digit} of {digits2}", "phone model {upper2}{digits3}",
    "numbers {digits4} {digits4} {digits4} {digits4} are on the box", "not {digits4} {digits4} {digits4} {digits4}", "{digits4} {digits4} {digits4} {digits4}, {word} {word}", "{word} {digits4} {digits4} {word} {digits4}", "the parcel was shipped on {daymonth} and came on {date}", "shipped {daymonth}", "on {daymonth} the shop opens at 10", "due date: {daymonth}", "delivered on {date} to the front desk", "the treaty of {daymonth}",
    # Long texts with nothing personal.
    "{prose80}", "{prose60}", "{prose70}", "{prose30}", "{prose40} {digits3} {prose40}", "{prose30} {year} {prose30} {digits2} {prose10}", "{prose20} {hex40} {prose20}", "{rows40}", "{rows60}", "{repeat40}", "{Repeat40}", "{Repeat20} {prose10}", "# {Word} {word} {prose40}", "{prose20} {date} {prose20} {digits8} {prose20}",
]
FIRST = "Anna Ben Clara David Emma Felix Greta Henry Ines Jonas Karla Leon Maria Nils Olga Paul Rosa Simon Tina Victor".split()
LAST = "Abel Brandt Carver Dumont Ellis Fischer Garcia Holm Ivers Jansen Keller Lopez Moreau Novak Olsen Perez Quinn Ritter Sanders Turner Ulrich Vogel Weber Young".split()
PHONES = ["{3}-{3}-{4}", "({3}) {3}-{4}", "({3}) {3} {4}", "{3}.{3}.{4}", "1-800-{3}-{4}", "0{2} {4} {4}", "0{4} {3} {3}", "0{3}-{7}", "0{3}/{6}", "{3} {3} {4}", "0{1} {2} {2} {2} {2}", "00{2} {3} {6}", "{3}-{4}", "0{10}"]
#: Words that tie a sentence together, in four languages.
TIES = "the of and to in is it at on by der die und von zu mit in ist auf le la de et les des en est un une el los las que y es por con".split()
MONTHS = "January February March April May June July August September October November December".split()
SYLLABLES = "ka lo mi ne su ta ri va do pe zu fa gi ho be".split()
LINES_EACH = 6


def _prose(size: int, rows: bool, rng: random.Random) -> str:
    """So many invented words: as sentences, or as rows of cells."""
    out, fresh = [], True
    for _ in range(size):
        word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5))) if rows or rng.random() < 0.6 else rng.choice(TIES)
        end = rng.choice([" | ", " | ", " |\n"]) if rows else rng.choice(["", "", "", "", "", "", "", ",", ".", ".\n"]) + " "
        out.append((word.capitalize() if fresh else word) + end)
        fresh = rng.random() < 0.2 if rows else "." in end
    return "".join(out).strip()


def _value(slot: str, rng: random.Random) -> str:
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    digits = lambda n: pick(string.digits, n)
    word = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 5)))
    alnum = string.ascii_letters + string.digits
    size = int("".join(c for c in slot if c.isdigit()) or 1)
    kind = slot.rstrip(string.digits)
    if kind in ("digit", "digits"):
        return digits(size)
    if kind in ("hex", "alnum", "upper"):
        return pick({"hex": "0123456789abcdef", "alnum": alnum, "upper": string.ascii_uppercase + (string.digits if size > 4 else "")}[kind], size)
    if kind == "iban":
        blocks = pick(string.ascii_uppercase, 2) + digits(2) + rng.choice(["", pick(string.ascii_uppercase, 4)]) + digits(rng.choice([14, 16, 18]))
        return " ".join(blocks[i : i + 4] for i in range(0, len(blocks), 4)) if size == 4 else blocks
    if kind in ("repeat", "Repeat"):
        own = rng.choice([word, rng.choice(TIES)])
        return " ".join([own.capitalize() if kind == "Repeat" else own] * size)
    if kind in ("prose", "rows"):
        return _prose(size, kind == "rows", rng)
    return {
        "letter": lambda: rng.choice(string.ascii_uppercase), "word": lambda: word, "Word": word.capitalize, "CAPS": word.upper, "first": lambda: rng.choice([*FIRST, *[word.capitalize()] * 60]), "last": lambda: rng.choice([*LAST, *[word.capitalize()] * 60]),
        "user": lambda: rng.choice([word, f"{word}.{rng.choice(LAST).lower()}", f"{word}_{digits(1)}", rng.choice(FIRST).lower()]), "year": lambda: str(rng.randint(1800, 2030)),
        "phone": lambda: "".join(digits(int(p)) if p.isdigit() and i % 2 else p for i, p in enumerate(rng.choice(PHONES).replace("}", "{").split("{"))),
        "key": lambda: rng.choice([pick("0123456789abcdef", rng.choice([24, 32, 40, 48, 64])), pick(alnum, rng.randint(16, 48)), pick(alnum + "+/", 40), f"{pick(alnum, 8)}-{pick(alnum, 12)}_{pick(alnum, 16)}"]),
        "password": lambda: word.capitalize() + rng.choice(["", "!", "#", "_", "$"]) + digits(rng.randint(1, 5)) + rng.choice(["", pick(alnum, 4), "!"]), "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "date": lambda: rng.choice(["{2}/{3}/{1}", "{1}-{2}-{3}", "{3}.{2}.{1}"]).replace("{1}", str(rng.randint(1930, 2020))).replace("{2}", f"{rng.randint(1, 12):02}").replace("{3}", f"{rng.randint(1, 28):02}"),
        "daymonth": lambda: rng.choice(["{d} {m} {y}", "{m} {d}, {y}", "{d}. {m} {y}"]).format(d=rng.randint(1, 28), m=rng.choice(MONTHS), y=rng.randint(1930, 2020)),
        "uuid": lambda: "-".join(pick("0123456789abcdef", n) for n in (8, 4, 4, 4, 12)), "url": lambda: f"https://{word}.example.org/{word}?id={digits(4)}",
    }[slot]()


def lines(templates: list[str] = TEMPLATES, each: int = LINES_EACH, seed: int = 10) -> list[str]:
    """So many lines of each template."""
    rng, out = random.Random(seed), []
    for template in templates:
        for _ in range(each):
            parts = template.replace("}", "{").split("{")
            out.append("".join(_value(p, rng) if i % 2 else p for i, p in enumerate(parts)))
    return out
