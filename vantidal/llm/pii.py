"""PII: detected entities are replaced with keyed surrogates of the same type and format.

Detection finds e-mail and IP addresses, phone, card, account and social security numbers, secrets given
as `name = value`, and names: after a title, before an address in angle brackets, after phrases that introduce a name, and
their parts wherever else the same text has them. An entity's surrogate follows from the key, its type and its normal form,
so one entity has one surrogate in all documents (coreference). Digits stay digits, letters stay letters of the same case and
script, cards keep their check digit valid or invalid as it was, an address keeps its form.

A name is replaced part by part: each part is an entity, so `Dr Anna Weber`, `Frau Anna Weber` and `Mrs Weber` stay one
person. What a part is (a given name of one gender, of both or of an unknown one, or a family name) is decided from all its
mentions in the corpus.

Collision checks: all surrogates of the corpus are compared. If two entities of a type got the same one,
or a surrogate is itself an entity of the corpus, the entity of larger hash draws again with the next
attempt number, until all are distinct; later attempts draw from wider spaces, so this ends. Almost always a text's own
mentions and attempt 0 stand, so only the few texts with other entities are joined with what was decided.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.llm.common import asked_for, batches, bounded, documents, without
from vantidal.session import forget, through_store

#: The setting that names the key.
KEY = "spark.vantidal.pii.key"
#: Attempts after which a surrogate may grow beyond its entity's length, and after which something must be wrong.
WIDEN, MOST = 6, 100


def key_of(spark: SparkSession) -> bytes:
    """The session's key. Without one the registered queries use an open key: their surrogates hide nothing from a reader of
    this source, so a real run sets the key."""
    return spark.conf.get(KEY, "an open key for tests").encode()


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    value: str  #: as found
    given: bool = False  #: of a name's part: a given name
    gender: str = ""  #: m or f where a title says so


# --- Detection ---------------------------------------------------------------------------------

_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9-]{0,62}\.)+[A-Za-z]{2,24}(?![\w-])", re.ASCII)
_IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")
_CARD = re.compile(r"(?<![\d-])\d{4}(?:([ -]?)\d{4})(?:\1\d{4})\1\d{1,4}(?![\d-]|\.\d)")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(
    r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}(?:[ .-]\d{3,4}){1,2}(?![\w-])|(?<![\w+])\+\d{8,15}(?!\w)"
    r"|(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-])"
)
_SECRET = re.compile(
    r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|client[_-]?secret)"
    r"(?P<sep>\s{0,3}[=:]\s{0,3})(?P<q>[\"']?)(?P<value>[A-Za-z0-9+/_.~-]{6,512}={0,2})(?P=q)"
)
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp|gho|sk|pk)_[A-Za-z0-9_]{16,255}")
#: A text without any of these has no such secret: they are looked for before the pattern is.
_SECRET_WORDS = ("pass", "pwd", "secret", "token", "key")
_KEY_MARKS = ("akia", "asia", "ghp_", "gho_", "sk_", "pk_")
#: Titles before a name, by gender.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Lord", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Fräulein", "Madame", "Mme", "Mlle", "Mademoiselle", "Señora", "Sra", "Señorita", "Srta", "Doña", "Dra", "Signora"),
    "n": ("Dr", "Prof", "Professor", "Mx", "Rev"),
}
#: What comes before a name that somebody gives.
PHRASES = ("my name is", "mein Name ist", "ich heiße", "je m'appelle", "mon nom est", "me llamo", "mi nombre es")
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_PART = r"[^\W\d_a-z][^\W\d_]+"
_ANY_TITLE = "|".join(sorted(_GENDER, key=len, reverse=True))
_NAME = re.compile(rf"\b(?P<titles>(?:(?:{_ANY_TITLE})\.?[ \xa0])+)(?P<name>{_PART}(?:[ -]{_PART}){{0,2}})")
_GIVEN_AS = re.compile(rf"(?:(?i:\b(?:{'|'.join(map(re.escape, PHRASES))})\b)[ \xa0])(?P<name>{_PART}(?:[ -]{_PART}){{1,2}})")
_ADDRESSEE = re.compile(rf"(?<!\w)(?P<name>{_PART}(?:[ -]{_PART}){{1,2}})(?=\"? <[^<>\s@]{{1,64}}@)")
_WORD = re.compile(r"[^\W\d_]+")


def _luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid card number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits))))


def is_card(value: str) -> bool:
    """Digits in groups are a card's; a bare number is one if its check digit holds and it begins as issuers' numbers do."""
    return not value.isdigit() or (value[0] in "23456" and _luhn(value) % 10 == 0)


def _fitted(taken: list[Entity], more: list[Entity]) -> list[Entity]:
    """Both lists in order of their starts, without those of `more` that overlap others; one pass over both."""
    out: list[Entity] = []
    i = 0
    for e in more:
        while i < len(taken) and taken[i].end <= e.start:
            out.append(taken[i])
            i += 1
        if (i == len(taken) or taken[i].start >= e.end) and (not out or out[-1].end <= e.start):
            out.append(e)
    return out + taken[i:]


def _parts(start: int, name: str, gender: str) -> Iterator[Entity]:
    """The parts of a name: all but the last word are given names; a title tells the gender of the first, or of a lone one."""
    words = name.split(" ")
    at = start
    for i, w in enumerate(words):
        for m in _WORD.finditer(w):
            given = i < len(words) - 1
            yield Entity("name", at + m.start(), at + m.end(), m[0], given, gender if i == 0 else "")
        at += len(w) + 1


def _names(text: str) -> list[Entity]:
    found: list[Entity] = []
    for m in _NAME.finditer(text):
        if not m["name"][0].islower():
            genders = [_GENDER[t.rstrip(".")] for t in re.split("[ \xa0]", m["titles"].strip(" \xa0"))]
            found += _parts(m.start("name"), m["name"], next((g for g in genders if g != "n"), ""))
    low = text.lower()
    cues = [_GIVEN_AS] if any(p.lower() in low for p in PHRASES) else []
    for pattern in [*cues, *([_ADDRESSEE] if "@" in text else [])]:
        found = _fitted(found, [e for m in pattern.finditer(text) for e in _parts(m.start("name"), m["name"], "")])
    known = {e.value: e for e in reversed(found) if len(e.value) > 2}
    if known:  # the same words elsewhere in the text
        again = [Entity("name", *m.span(), m[0], known[m[0]].given) for m in _WORD.finditer(text) if m[0] in known]
        found = _fitted(found, again)
    return found


def detect(text: str | None) -> list[Entity]:
    """The entities of a text in order, without overlaps: of two that overlap the earlier type of this list counts."""
    if not text:
        return []
    by_start = lambda found: sorted(found, key=lambda e: (e.start, -e.end))
    low = text.lower()
    secrets = [Entity("secret", *m.span(), m[0]) for m in _KEY_ID.finditer(text)] if any(w in low for w in _KEY_MARKS) else []
    if ("=" in text or ":" in text) and any(w in low for w in _SECRET_WORDS):
        secrets += [Entity("secret", *m.span("value"), m["value"]) for m in _SECRET.finditer(text)]
    found = _fitted([], by_start(secrets))
    if "@" in text:
        found = _fitted(found, [Entity("email", *m.span(), m[0]) for m in _EMAIL.finditer(text)])
    if any(c in text for c in "0123456789"):
        for kind, pattern in (("ip", _IP), ("iban", _IBAN), ("card", _CARD), ("ssn", _SSN), ("phone", _PHONE)):
            found = _fitted(found, [Entity(kind, *m.span(), m[0]) for m in pattern.finditer(text) if kind != "card" or is_card(m[0])])
    return _fitted(found, _names(text))


_SIGNS = re.compile(r"[^0-9A-Za-z+]")


def normal(kind: str, value: str) -> str:
    """What counts as the same entity: case of addresses and names and separators of numbers don't."""
    if kind in ("email", "ip", "name"):
        return value.lower()
    if kind in ("card", "ssn", "phone", "iban"):
        return _SIGNS.sub("", value).upper()
    return value


def role(given: bool, m: bool, f: bool) -> str:
    """What a name's part is: s (a family name) or g with m, f or n (unknown, or of both)."""
    return "s" if not given else "gm" if m and not f else "gf" if f and not m else "gn"


def entities_of(text: str | None) -> dict[tuple[str, str], tuple[bool, bool, bool]]:
    """kind and normal form of a text's entities; of names whether a mention is given, or its title tells m or f."""
    out: dict[tuple[str, str], tuple[bool, bool, bool]] = {}
    for e in detect(text):
        k = (e.kind, normal(e.kind, e.value))
        given, m, f = out.get(k, (False, False, False))
        out[k] = (given or e.given, m or e.gender == "m", f or e.gender == "f")
    return out


# --- Surrogates --------------------------------------------------------------------------------

#: How made-up given names end.
ENDINGS = {"m": ("o", "us", "an", "ik"), "f": ("a", "ia", "ina", "ette"), "n": ("i", "e", "y", "is")}
ONSETS, VOWELS = "bdfgklmnprstvz", "aeiou"
#: Letters that surrogates in other scripts are made of, by the first code point of the script's block.
SCRIPTS = {0x0370: "αβγδεικλμνορστ", 0x0400: "абвгдеиклмнорст", 0x0590: "אבגדהוזחטיכל", 0x0600: "ابتثجحدرسع", 0x3040: "あいうえおかきくけこ", 0x4E00: "安百成大方高海江金林"}


class Draw:
    """A stream of keyed numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.key, self.seed, self.n = key, f"{kind}\0{norm}\0{attempt}".encode("utf-8", "surrogatepass"), 0
        self.pool = 0
        self.left = 0

    def below(self, most: int) -> int:
        if self.left < 32:
            block = hmac.new(self.key, self.seed + b"\0" + str(self.n).encode(), hashlib.sha256).digest()
            self.pool, self.left, self.n = int.from_bytes(block, "big"), 256, self.n + 1
        out = (self.pool & 0xFFFFFFFF) * most >> 32
        self.pool >>= 32
        self.left -= 32
        return out

    def pick(self, items):
        return items[self.below(len(items))]


def _like(draw: Draw, text: str) -> str:
    """Digits for digits, letters for letters of the same case (and script, as far as known), signs as they are."""
    hexadecimal = re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*|\d+", text) is not None
    out = []
    for c in text:
        if c.isascii():
            if c.isdigit():
                out.append(str(draw.below(10)))
            elif c.isalpha():
                x = "abcdef"[draw.below(6)] if hexadecimal else chr(97 + draw.below(26))
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        elif c.isalpha():
            out.append(_letter(draw, c))
        else:
            out.append(c)
    return "".join(out)


def _letter(draw: Draw, c: str) -> str:
    start = max((s for s in SCRIPTS if s <= ord(c)), default=None)
    if start is None or ord(c) < 0x0370:
        x = chr(97 + draw.below(26))
    else:
        x = draw.pick(SCRIPTS[start])
    return x.upper() if c.isupper() else x


def _word(draw: Draw, syllables: int) -> str:
    return "".join(draw.pick(ONSETS) + draw.pick(VOWELS) for _ in range(syllables))


def core(key: bytes, kind: str, norm: str, attempt: int, part: str = "") -> str:
    """The surrogate's normal form. `part` is what a name's part is. After WIDEN attempts it grows with each."""
    d = Draw(key, kind, norm, attempt)
    more = max(0, attempt - WIDEN)
    digits = lambda n: "".join(str(d.below(10)) for _ in range(n))
    if kind == "email":
        local, _, _ = norm.rpartition("@")
        name = re.sub(r"[a-z]+", lambda m: "".join(chr(97 + d.below(26)) for _ in m[0]), re.sub(r"\d", lambda _: str(d.below(10)), local))
        return f"{name}@{_word(d, 4 + more)}.invalid" if len(local) >= 6 else f"{name}{_word(d, 3)}@{_word(d, 4 + more)}.invalid"
    if kind == "ip":  # 240.0.0.0/4 is reserved; beyond it any address that the corpus doesn't have
        return ".".join([str(d.below(256) if more else 240 + d.below(15)), *(str(d.below(256)) for _ in range(3))])
    if kind == "card":
        body = "9" + digits(len(norm) - 2 + more)  # no issuer's cards begin with 9
        check = next(c for c in "0123456789" if _luhn(body + c) % 10 == 0)
        return body + (check if _luhn(norm) % 10 == 0 else str((int(check) + 1 + d.below(9)) % 10))
    if kind == "ssn":
        return (digits(1) if more else "9") + digits(8 + max(0, more - WIDEN))  # numbers that begin with 9 aren't issued
    if kind == "iban":
        body = "".join(str(d.below(10)) if c.isdigit() else chr(65 + d.below(26)) for c in norm[4:]) + digits(more)
        return f"{norm[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + norm[:2] + '00')) % 97:02d}{body}"
    if kind == "phone":
        keep = re.match(r"\+\d{1,3}(?=\d{9,10}$)|\+?", norm)[0]  # the country's code
        return keep + digits(len(norm) - len(keep) + more)
    if kind == "name":
        if norm.isascii() or max(map(ord, norm)) < 0x0370:
            if part.startswith("g"):
                return _word(d, 2 + attempt // 3) + d.pick(ENDINGS[part[1]])
            return _word(d, 4 + attempt // 3)
        letters = norm + norm[-1] * (attempt // 3)
        return "".join(_letter(d, c) if c.isalpha() else c for c in letters)
    keep = re.match(r"AKIA|ASIA|(?:ghp|gho|sk|pk)_|", norm)[0]  # the mark of a key's maker
    return keep + _like(d, norm[len(keep) :] + "x" * more)


def dressed(kind: str, surrogate: str, value: str) -> str:
    """The surrogate in the format that the entity was found in: the same separators and case."""
    if kind in ("card", "ssn", "phone", "iban"):
        it = iter(surrogate)
        return "".join(next(it, "") if re.match(r"[0-9A-Za-z+]", c) else c for c in value) + "".join(it)
    if kind in ("email", "name") and value.isupper() and len(value) > 1:
        return surrogate.upper()
    if kind == "name" and value[0].isupper():
        return surrogate[0].upper() + surrogate[1:]
    return surrogate


Decided = dict[tuple[str, str], tuple[int, str]]


def rewrite(text: str | None, key: bytes, decided: Decided) -> tuple[str | None, list[tuple]]:
    """The text with surrogates, and a span (kind, start, end, surrogate) for each in the new text.

    `decided` has attempt and part of the entities for which attempt 0 and what this text says don't stand.
    """
    found = detect(text)
    if not found:
        return text, []
    own = {k: (0, role(*v) if k[0] == "name" else "") for k, v in entities_of(text).items()} if any(e.kind == "name" for e in found) else {}
    made: dict[tuple[str, str], str] = {}
    out, spans, at, grown = [], [], 0, 0
    for e in found:
        k = (e.kind, normal(e.kind, e.value))
        if k not in made:
            attempt, part = decided.get(k) or own.get(k) or (0, "")
            made[k] = core(key, *k, attempt, part)
        s = dressed(e.kind, made[k], e.value)
        out += [text[at : e.start], s]
        spans.append((e.kind, e.start + grown, e.start + grown + len(s), s))
        grown += len(s) - (e.end - e.start)
        at = e.end
    return "".join([*out, text[at:]]), spans


# --- The corpus --------------------------------------------------------------------------------


def mentions(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """k (the text's hash), kind, norm, given, m, f and part of each entity of a text."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(rows):
            at, found = [], []
            for i, t in enumerate(texts):
                for (kind, norm), said in entities_of((t or b"").decode("utf-8", "replace")).items():
                    at.append(i)
                    found.append((kind, norm, *said, role(*said) if kind == "name" else ""))
            if found:
                kinds = (pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string())
                cols = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(at, pa.int32())), *cols], ["k", "kind", "norm", "given", "m", "f", "part"])

    picked = bounded(docs.select(F.xxhash64(text_col).alias("k"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL"))
    return picked.mapInArrow(run, "k bigint, kind string, norm string, given boolean, m boolean, f boolean, part string")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, part, attempt and the surrogate of that attempt."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            kinds, norms, parts, attempts = (batch.column(c).to_pylist() for c in ("kind", "norm", "part", "attempt"))
            cores = [core(key, k, n, a, p) for k, n, p, a in zip(kinds, norms, parts, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "norm", "part", "attempt")), pa.array(cores, pa.string())],
                                             ["kind", "norm", "part", "attempt", "core"])

    picked = entities.select("kind", "norm", "part", F.col("attempt").cast("int").alias("attempt"))
    return picked.mapInArrow(run, "kind string, norm string, part string, attempt int, core string")


def settled(entities: DataFrame, key: bytes, now: DataFrame | None = None) -> DataFrame:
    """kind, norm, part, attempt and core of all entities (kind, norm, part, each once), all cores distinct.

    A surrogate shared by two entities of a kind, or equal to an entity's normal form, is kept by none but the entity of the
    least attempt and hash (by none in the second case). `now` gives draws to begin with.
    """
    now = now if now is not None else through_store(_drawn(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    real = entities.select("kind", F.col("norm").alias("core")).distinct()
    order = F.struct("attempt", F.xxhash64("kind", "norm"), "norm")
    for _ in range(MOST):
        first = now.groupBy("kind", "core").agg(F.min(order).alias("first"), F.count("*").alias("k")).filter("k > 1")
        shared = now.join(first, ["kind", "core"]).filter(order != F.col("first")).select("kind", "norm", "part", "attempt")
        taken = now.join(real, ["kind", "core"], "left_semi").select("kind", "norm", "part", "attempt")
        bad = through_store(shared.union(taken).distinct(), "collisions")
        if bad.isEmpty():
            forget(bad)
            return now
        new = _drawn(bad.withColumn("attempt", F.col("attempt") + 1), key)
        old, now = now, through_store(now.join(bad.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(new), "surrogates")
        forget(old, bad)
    raise RuntimeError("surrogates can't be made distinct")


SPANS = "array<struct<kind:string,start:int,end:int,surrogate:string>>"


def replace_entities(
    docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """id, the kept columns, text with surrogates and spans, for every row.

    A null text stays null and an empty one empty, both without spans. Rows that repeat an id are rewritten
    each, by the same surrogates, and so are rows with a null id. Spans count characters of the new text.
    """
    found = through_store(mentions(docs, text_col), "mentions")
    entities = found.groupBy("kind", "norm").agg(
        F.bool_or("given").alias("given"), F.bool_or("m").alias("m"), F.bool_or("f").alias("f"), F.min("part").alias("least"), F.max("part").alias("most")
    )
    gender = F.when(F.col("m") & ~F.col("f"), "gm").when(F.col("f") & ~F.col("m"), "gf").otherwise("gn")
    part = F.when(F.col("kind") != "name", "").when(F.col("given"), gender).otherwise("s")
    entities = through_store(entities.select("kind", "norm", part.alias("part"), ((F.col("least") != part) | (F.col("most") != part)).alias("mixed")), "entities")
    final = settled(entities, key)
    special = final.join(entities.filter("mixed").select("kind", "norm", "mixed"), ["kind", "norm"], "left").filter("attempt > 0 OR mixed")
    special = through_store(special.select("kind", "norm", F.col("attempt").alias("attempt"), F.col("part").alias("decided")), "special")
    kinds = dict(docs.dtypes)
    names = [id_col, *keep]
    picked = bounded(docs.select(
        *(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), F.xxhash64(text_col).alias("k"), F.col(text_col).cast("string").alias("text")
    ))
    none = F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int,decided:string>>")
    if special.isEmpty():
        rows = picked.withColumn("decided", none)
        own = None
    else:  # what was decided of a text's own entities, gathered by text; other texts aren't shuffled
        hers = found.join(special, ["kind", "norm"]).filter("attempt > 0 OR part <> decided")
        own = through_store(hers.groupBy("k").agg(F.collect_set(F.struct("kind", "norm", "attempt", "decided")).alias("decided")), "decided")
        few = asked_for(picked, own.select("k"), "k").join(own, "k").select(*picked.columns, "decided")
        rows = without(picked, own.select("k"), "k").withColumn("decided", none).unionByName(few)
    rows = rows.select(*(f"c{i}" for i in range(len(names))), "decided", "text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
        for batch, raw in batches(rows):
            texts, spans = [], []
            for t, a in zip(raw, batch.column("decided").to_pylist(), strict=True):
                text = None if t is None else t.decode("utf-8", "replace")
                new, s = rewrite(text, key, {(x["kind"], x["norm"]): (x["attempt"], x["decided"]) for x in a or ()})
                texts.append(new)
                spans.append([dict(zip(("kind", "start", "end", "surrogate"), x, strict=True)) for x in s])
            cols = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(texts, pa.string()), pa.array(spans, span)], [*batch.schema.names[: len(names)], "text", "spans"]
            )

    forget(found, entities, final, special)
    head = ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(names))
    out = rows.mapInArrow(run, f"{head}, text string, spans {SPANS}")
    out = out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("text").alias(text_col), "spans")
    out._reads = (own,) if own is not None else ()
    return out


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_entities(documents(spark, sf_dir), key_of(spark))
    return out.select("doc_id", F.size("spans").cast("long").alias("n_entities"), "text", "spans")
