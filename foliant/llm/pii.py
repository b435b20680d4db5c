"""Operator 8, personal data: a semi-Markov conditional random field over token spans.

Base kinds (email, ip, card, phone) follow the contract and always stay: they enter the field as observed segments. The
further kinds (iban, ssn, national for a phone number without country code, and name) are segments that the field may choose:
around every token with a digit, a title, a cue for a name or a common first name, all segments of up to BOUNDS tokens that
have the shape of a kind are scored as a whole (checksum, grouping of the digits, cue words and misleading words before, first
name, place in the sentence, neighbours), and dynamic programming chooses boundaries and kinds together, outside the observed
segments.

The weights are trained here, by gradient ascent on the conditional likelihood of seeded sentences made from templates in
four languages, whose spans are known; training takes a few seconds on the driver and gives the same weights everywhere.

Defined results: a null text counts as empty and gives no spans; a null id is scanned as any other; repeated rows each give
a row; an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import arrow_map, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "national", "name")
BASE = KINDS[:4]
#: Longest segment of a kind, in tokens; that of an IBAN is 34 letters and digits in groups of four.
BOUNDS = {"iban": 9, "ssn": 5, "national": 12, "name": 7}
#: Tokens around a hot one that may belong to a segment with it.
REACH = 12
#: Score of an observed segment.
OBSERVED = 1e6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return _NOT_DIGIT.sub("", s)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by start and then kind as listed. Time is linear in the text."""
    found, over = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end(), "email"))
            over = m.end()
        at = text.find("@", max(at + 1, over))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
            found.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        d = digits_of(m[0])
        if len(d) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                found.append((m.start(), m.end(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


# ---- the field over token spans ----

#: The group holds words of letters alone.
TOKEN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)(?![A-Za-zÀ-ÖØ-öø-ÿ0-9])|[A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[^\w\s]|_")
#: Titles that open a name, words that tell of a name, and words that tell of a number's kind or of no such kind.
TITLES = frozenset("mr mrs ms dr prof herr herrn frau sr sra señor señora m mme monsieur madame".split())
NAMED = frozenset("name named nom nombre nommé heiße heißt hieß appelle llamo llama called signed sincerely regards dear sehr chère cher estimado estimada gezeichnet signé firmado contact author".split())
CUES = {
    "iban": frozenset("iban account konto kontonummer cuenta compte bank".split()),
    "ssn": frozenset("ssn social security".split()),
    "national": frozenset("call phone tel telefon telephone téléphone teléfono mobile handy mobil móvil portable fax ring dial rufen appelez llame nummer number numéro número".split()),
    "name": TITLES | NAMED,
}
MISLEADING = frozenset("page pages seite página version art article artikel artículo section figure table room order bestellung commande pedido invoice rechnung facture factura isbn price preis prix precio year jahr année año score between from to vol no nr id ticket chapter paragraph".split())
DETERMINERS = frozenset("the a an this der die das den dem des ein eine le la les l un une du el los las del".split())
#: Common first names of the four languages (plain values).
FIRST = frozenset((
    "James John Robert Michael William David Richard Joseph Thomas Charles Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Emily "
    "Daniel Matthew Anthony Mark Paul Steven Andrew Kevin Brian George Nancy Margaret Helen Laura Alice Emma Olivia Sophia Peter Oliver "
    "Hans Klaus Jürgen Wolfgang Stefan Andreas Matthias Uwe Sabine Petra Monika Ursula Heike Katrin Julia Lukas Jonas Felix Greta Lena "
    "Jean Pierre Michel Philippe Jacques Nicolas Laurent Julien Antoine Camille Marie Nathalie Isabelle Sylvie Claire Sophie Élodie Chloé Manon Hugo "
    "José Juan Carlos Luis Javier Miguel Manuel Francisco Antonio Pedro María Carmen Lucía Pilar Marta Elena Rosa Sofía Paula Diego"
).split())
_HOT = FIRST | {form for w in CUES["name"] for form in (w, w.capitalize(), w.upper())}
_UPPER = "A-ZÀ-ÖØ-Þ"
_NAME = rf"[{_UPPER}](?:[a-zß-öø-ÿ]+|['’][{_UPPER}][a-zß-öø-ÿ]+)(?:-[{_UPPER}][a-zß-öø-ÿ]+)?"
SHAPES = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "national": re.compile(r"(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-][0-9]{2,8}){1,4}|0[0-9]{8,11}"),
    "name": re.compile(rf"{_NAME}(?:\x20(?:[{_UPPER}]\.|(?:de|la|von|van|del)\x20{_NAME}|{_NAME})){{0,2}}"),
}
_GROUPS = re.compile("[0-9]+")


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, start: int, end: int, kind: str, before: tuple[str, ...], opens: bool, follows: bool) -> list[str] | None:
    """Features of the whole span as this kind; None where it can't be of the kind. `opens`: it begins a sentence; `follows`: it stands behind another capital."""
    s = text[start:end]
    if not SHAPES[kind].fullmatch(s):
        return None
    out = [f"{kind}:bias"]
    if any(w in CUES[kind] for w in before):
        out.append(f"{kind}:cue")
    if before and before[-1] in CUES[kind]:
        out.append(f"{kind}:cue-next")
    if any(w in MISLEADING for w in before[-2:]):
        out.append(f"{kind}:misleading")
    if kind == "name":
        parts = s.split(" ")
        first = parts[0] in FIRST
        out.append(f"name:{'first' if first else 'other'}{min(len(parts), 3)}")
        if before and before[-1] in TITLES:
            out.append("name:title")
        if before and before[-1] in NAMED:
            out.append("name:named")
        if before and before[-1] in DETERMINERS:
            out.append("name:determined")
        if follows:
            out.append("name:follows")
        out.append(f"name:{'opens' if opens else 'within'}{'-first' if first else ''}")
        if parts[0].lower() in TITLES or parts[0].lower() in NAMED:
            out.append("name:is-cue")
        rest = text[end : end + 2]
        if rest[:1] == " " and rest[1:].isupper():
            out.append("name:goes-on")
    else:
        groups = "-".join(str(len(g)) for g in _GROUPS.findall(s)) if kind != "iban" else ""
        out.append(f"{kind}:groups{groups}")
        if s[0] in "0(":
            out.append(f"{kind}:trunk")
        if kind == "iban":
            out.append("iban:check" if iban_ok(s) else "iban:no-check")
        if kind == "ssn":
            out.append("ssn:valid" if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else "ssn:void")
        if kind == "national":
            n = sum(c.isdigit() for c in s)
            out.append(f"national:digits{n}")
    if start and (text[start - 1].isalnum() or text[start - 1] in "+-.@_/#$€£:"):
        out.append(f"{kind}:joined-left")
    if end < len(text) and (text[end].isalnum() or text[end] in "-@_/%€" or text[end] in ".,:" and end + 1 < len(text) and text[end + 1].isalnum()):
        out.append(f"{kind}:joined-right")
    return out


def regions(text: str):
    """Runs of tokens near a hot token: the tokens as (start, end), and the first and last of the run."""
    found = list(TOKEN.finditer(text))
    hot = [i for i, m in enumerate(found) if (m[1] in _HOT if m.lastindex else text[m.start()].isalnum())]
    if not hot:
        return
    tokens, i = [m.span() for m in found], 0
    while i < len(hot):
        first, last = max(0, hot[i] - REACH), hot[i] + REACH
        i += 1
        while i < len(hot) and hot[i] - REACH <= last:
            last = hot[i] + REACH
            i += 1
        yield tokens, first, min(last, len(tokens))


def segments(text: str, tokens, first: int, last: int, observed=()):
    """(i, j, kind, features) of the segments of tokens i to j that may be of a kind, outside the observed ones; those come with None."""
    begins, ends = {tokens[k][0]: k for k in range(first, last)}, {tokens[k][1]: k + 1 for k in range(first, last)}
    closed: set[int] = set()
    if observed and first < last:
        low, high = tokens[first][0], tokens[last - 1][1]
        for a, b, kind in observed:
            if a < high and low < b:
                closed.update(k for k in range(first, last) if tokens[k][0] < b and a < tokens[k][1])
                if a in begins and b in ends:
                    yield begins[a], ends[b], kind, None
    for i in range(first, last):
        c = text[tokens[i][0]]
        if i in closed:
            continue
        kinds = ("national", "ssn") if c.isdigit() else ("national",) if c == "(" else ("iban", "name") if c.isupper() else ()
        if not kinds:
            continue
        before = tuple(text[a:b].lower() for a, b in tokens[max(0, i - 5) : i] if text[a].isalpha())[-3:]
        gap = text[tokens[i - 1][1] : tokens[i][0]] if i else ""
        opens = i == 0 or "\n" in gap or text[tokens[i - 1][0]] in ".!?:|\"«“"
        follows = gap == " " and text[tokens[i - 1][0]].isupper() and not (before and before[-1] in CUES["name"])
        for kind in kinds:
            m = SHAPES[kind].match(text, tokens[i][0])
            if not m:
                continue
            for j in range(i + 1, min(last, i + BOUNDS[kind]) + 1):
                if j - 1 in closed or tokens[j - 1][1] > m.end() + 1:
                    break
                if f := features(text, tokens[i][0], tokens[j - 1][1], kind, before, opens, follows):
                    yield i, j, kind, f


def decode(text: str, weights: dict[str, float], observed=()) -> list[tuple[int, int, str]]:
    """Best-scoring non-overlapping spans, by Viterbi over segments; outside tokens score 0."""
    found = []
    for tokens, first, last in regions(text):
        ends: dict[int, list] = {}
        for i, j, kind, f in segments(text, tokens, first, last, observed):
            score = OBSERVED if f is None else sum(weights.get(x, 0.0) for x in f)
            ends.setdefault(j, []).append((i, kind, score))
        if not ends:
            continue
        best, back = {first: 0.0}, {}
        for j in range(first + 1, last + 1):
            best[j], back[j] = best[j - 1], None
            for i, kind, score in ends.get(j, ()):
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, kind)
        j = last
        while j > first:
            if back[j]:
                i, kind = back[j]
                found.append((tokens[i][0], tokens[j - 1][1], kind))
                j = i
            else:
                j -= 1
    return sorted(found)


#: What the training sentences are made of: `{kind}` is filled in and known, `{x}` and the like are filled in and are none.
TEMPLATES = {
    "en": "Please call {national} after noon.|My name is {name} and I live in {place}.|{name} said that the work was done.|Dear {name}, thank you for the letter.|Mr. {name} met Dr. {name} in {place}.|Her social security number is {ssn}.|Send the money to account {iban} today.|You can reach {name} at {national} or by mail.|The author {name} wrote {num} pages in {year}.|The meeting with {name} starts at {time}.|IBAN: {iban}|SSN {ssn}|Pay from {iban} to {iban}, year {year}.|phone {national}|See page {num} of version {version}.|The price rose from {price} to {price} on {date}.|Order {code} was sent on {date} at {time}.|Table {num} shows the result of {year}.|{word} {word} {word}. {cap} {word} {word}.|{cap} {word} the {word} in {place}.|Between {year} and {year} it was {num} - {num}.|Call {name}: {national}.|Yesterday {name} came to {place} with {name}.|Licensed under the {cap} {cap}, version {num}.|Under the GNU {cap} {cap} {cap}, see NASA {cap} {cap}.|The {cap} {cap} {cap} of {place} {cap} met in {year}.|{cap} {cap} {cap}",
    "de": "Bitte rufen Sie {national} an.|Mein Name ist {name} und ich wohne in {place}.|Herr {name} und Frau {name} kamen am {date}.|Das Konto {iban} gehört {name}.|Telefon {national}, Fax {national}|Ich heiße {name}.|Siehe Seite {num} in Band {num}.|Die Rechnung {code} vom {date} über {price}.|{cap} {word} die {word} und {word}.|Der {cap} {word} {word} {cap} {word}.|Im Jahr {year} waren es {num} {cap}.|Gestern hat {name} das Buch gelesen.|Die {cap} {cap} und das {cap} {cap} sind neu.",
    "fr": "Appelez le {national} avant midi.|Je m'appelle {name}.|Madame {name} habite à {place}.|Mon compte est {iban}.|Le {date} à {time}, {name} est venu.|Téléphone : {national}|Voir page {num} de la version {version}.|Le prix est de {price} en {year}.|{cap} {word} les {word} et {word}.|La facture {code} du {date}.|Monsieur {name} et {name} ont signé.|Le {cap} {cap} de la {cap} {cap}.",
    "es": "Llame al {national} por la tarde.|Me llamo {name} y vivo en {place}.|El señor {name} vino el {date}.|La cuenta {iban} es de {name}.|Teléfono: {national}|Ver página {num} de la versión {version}.|El precio es {price} en {year}.|{cap} {word} los {word} y {word}.|El pedido {code} del {date}.|Ayer {name} leyó el libro en {place}.",
}
PLACES_ = "Berlin London Madrid Paris Hamburg Boston Lyon Sevilla Wien Dublin Europe Canada".split()


def synthetic(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with known spans, and numbers and capitals that are none."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda low=1, high=4: "".join(r.choice(("th", "on", "er", "le", "ma", "qu", "in", "ta", "os", "en", "ver", "ion")) for _ in range(r.randint(low, high)))
    first = sorted(FIRST)

    def iban():
        country, size = r.choice((("DE", 18), ("FR", 23), ("ES", 20), ("GB", 18), ("NL", 14)))
        body = "".join(r.choice("0123456789ABCDEFGH" if country in ("FR", "GB", "NL") else "0123456789") for _ in range(size))
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
        plain = f"{country}{check:02d}{body}"
        return plain if r.random() < 0.5 else " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))

    def surname():
        return r.choice((lambda: word(2, 3).capitalize(), lambda: word(1, 2).capitalize() + r.choice(("son", "mann", "ez", "ier", "er", "ton", "ard")), lambda: "O'" + word(1, 2).capitalize(), lambda: word(2, 2).capitalize() + "-" + word(2, 2).capitalize()))()

    def name():
        a = r.choice(first) if r.random() < 0.9 else word(2, 3).capitalize()
        return r.choice((lambda: f"{a} {surname()}", lambda: f"{a} {surname()}", lambda: f"{a} {r.choice('ABCDEFGHJKLMNPRST')}. {surname()}", lambda: f"{a} {r.choice(('de', 'la', 'von', 'van'))} {surname()}"))()

    make = {
        "iban": iban,
        "ssn": lambda: f"{r.randint(100, 600)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}",
        "national": lambda: r.choice((f"({num(3)}) {num(3)}-{num(4)}", f"0{num(3)} {num(3)} {num(3)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(6)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"{num(3)} {num(3)} {num(3)}", f"0{num(9)}", f"0{num(3)}/{num(7)}", f"{num(3)}.{num(3)}.{num(4)}")),
        "name": name,
    }
    none = {
        "place": lambda: r.choice(PLACES_), "word": word, "cap": lambda: r.choice((word().capitalize(), r.choice(PLACES_))), "num": lambda: num(r.randint(1, 5)), "year": lambda: str(r.randint(1900, 2030)), "time": lambda: f"{r.randint(0, 23)}:{num(2)}",
        "price": lambda: r.choice((f"${num(3)}.{num(2)}", f"{num(2)} {num(3)} €", f"{num(2)}.{num(3)},{num(2)} €", f"{num(4)} dollars")), "version": lambda: f"{num(1)}.{num(2)}.{num(1)}",
        "date": lambda: r.choice((f"{r.randint(1, 31)}.{r.randint(10, 12)}.{r.randint(1990, 2030)}", f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 28)}/{r.randint(10, 12)}/{r.randint(1990, 2030)}")),
        "code": lambda: r.choice((f"{num(4)}-{num(2)}", f"AB{num(2)} {num(4)} {num(4)} {num(4)}", num(10), f"{num(4)} {num(4)}", "".join(r.choice("0123456789ABCDEF") for _ in range(r.randint(12, 30))))),
    }
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            template = r.choice(TEMPLATES[r.choice(sorted(TEMPLATES))].split("|"))
            for k, part in enumerate(re.split(r"[{}]", template)):
                if k % 2 == 0:
                    text += part
                    continue
                v = (make.get(part) or none[part])()
                if part in make:
                    whole = v if part != "name" or not text.lower().rstrip(". ").endswith(("mr", "dr", "herr", "frau", "madame", "monsieur", "señor")) or r.random() < 0.5 else v.split(" ")[-1]
                    v = whole
                    spans.append((len(text), len(text) + len(v), part))
                text += v
            text += r.choice((" ", "\n"))
        out.append((text, spans))
    return out


def marginals(found: list[tuple], score: list[float], first: int, last: int) -> list[float]:
    """Probability of each segment (i, j, ...) under the field, by the forward and backward sums over segments."""
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for k, s in enumerate(found):
        by_end.setdefault(s[1], []).append(k)
        by_start.setdefault(s[0], []).append(k)

    def log_sum(v):
        m = max(v)
        return m + math.log(sum(math.exp(x - m) for x in v))

    ahead, behind = {first: 0.0}, {last: 0.0}
    for j in range(first + 1, last + 1):
        ahead[j] = log_sum([ahead[j - 1], *(ahead[found[k][0]] + score[k] for k in by_end.get(j, ()))])
    for i in range(last - 1, first - 1, -1):
        behind[i] = log_sum([behind[i + 1], *(behind[found[k][1]] + score[k] for k in by_start.get(i, ()))])
    return [math.exp(min(0.0, ahead[s[0]] + score[k] + behind[s[1]] - ahead[last])) for k, s in enumerate(found)]


@lru_cache(maxsize=1)
def trained(sentences: int = 1500, epochs: int = 8, rate: float = 0.4) -> dict[str, float]:
    """Weights after stochastic gradient ascent on the conditional log-likelihood."""
    data = []
    for text, gold in synthetic(sentences):
        want = set(gold)
        for tokens, first, last in regions(text):
            found = [(i, j, f, (tokens[i][0], tokens[j - 1][1], k) in want) for i, j, k, f in segments(text, tokens, first, last)]
            if found:
                data.append((first, last, found))
    w: dict[str, float] = {}
    for epoch in range(epochs):
        step = rate / (1 + epoch / 2)
        for first, last, found in data:
            score = [sum(w.get(x, 0.0) for x in f) for _, _, f, _ in found]
            for (_, _, f, gold), p in zip(found, marginals(found, score, first, last), strict=True):
                if abs(gold - p) > 1e-3:
                    for x in f:
                        w[x] = w.get(x, 0.0) + step * (gold - p) - 1e-4 * w.get(x, 0.0)
    return w


def all_spans(text: str, weights: dict[str, float]) -> tuple[list, list]:
    """Base spans, and all spans, each by start and then kind as listed."""
    base = base_spans(text)
    return base, sorted({*base, *decode(text, weights, base)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(found) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in found)


def masked(text: str, found) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in brackets."""
    out, over = [], 0
    for start, end, kind in found:
        if start >= over:
            out += [text[over:start], f"[{kind.upper()}]"]
        over = max(over, end)
    return "".join([*out, text[over:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: counts of the base kinds, digest of the base spans, all spans, and how many of them the field added."""
    weights = trained()

    def make():
        def f(batch):
            out = {"doc_id": batch.column(0).to_pylist()} | {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": [], "n_added": []}
            for text in batch.column(1).to_pylist():
                base, found = all_spans(text or "", weights)
                for k in BASE:
                    out[f"n_{k}"].append(sum(s[2] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(found))
                out["n_added"].append(len(found) - len(base))
            return out

        return f

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), make, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint", text_col)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with personal data masked in the text; all other columns as they are. A null text stays null."""
    weights = trained()
    schema, names = docs.schema, docs.columns

    def make():
        def f(batch):
            out = {c: batch.column(k) for k, c in enumerate(names)}
            out[text_col] = [None if t is None else masked(t, all_spans(t, weights)[1]) for t in out[text_col].to_pylist()]
            return out

        return f

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out = arrow_map(docs, make, ddl, text_col)
    return out.withColumn("n_chars", F.length(text_col).cast(schema["n_chars"].dataType)) if "n_chars" in names else out


def op8_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


QUERIES = {"op8_pii_spans": op8_pii_spans}
SQL: dict[str, str] = {}
