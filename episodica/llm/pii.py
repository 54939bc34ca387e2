"""Personal data: fixed patterns as seeds, then bootstrapped contextual extraction (operator 5)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from episodica.llm.shared import cut, fresh_path, slices, table

KINDS = ("email", "ip", "card", "phone")
#: What the method adds beyond those: keys, tokens, bank, passport and other numbers, of any form.
OTHER = "id"
Span = tuple[int, int]

# The characters and patterns of the four kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Identifiers in several words: numbers and marks side by side; (at), at or a lone @, and what may follow as a host.
_RUN = re.compile(r"(?<![^\s\[{\"'<,;:])\(?[0-9][0-9().+/_:-]*(?:[ \t]{1,2}(?:[-/.] )?\(?[0-9][0-9().+/_:-]*)+")
_AT = re.compile(r"\s{0,2}(?:[(\[{]\s?at\s?[)\]}]|\sat\s(?=[a-z0-9-]+\s{0,2}(?:[(\[{]\s?dot|\sdot\s|\s?dot\s))|\s@|@\s)\s{0,2}", re.I)
_HOST = re.compile(r"[a-z0-9-]+(?:(?:\.|\s{0,2}[(\[{]\s?dot\s?[)\]}]\s{0,2}|\s{1,2}dot\s{1,2})[a-z0-9-]+)+", re.I)
#: Words of a run. Parts that the instances of a pattern are dealt to.
WORDS, SALTS = 6, 16
#: Seeds of the other identifiers, in a token or (the last three) in a text.
_KEY = re.compile(
    r"(?<![0-9A-Za-z])(?:(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])(?:[0-9a-fA-F]{64}|[0-9a-fA-F]{40}|[0-9a-fA-F]{32})(?![0-9A-Za-z])"
    r"|AKIA[0-9A-Z]{16}(?![0-9A-Z])|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+)"
)
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![0-9A-Za-z])")
_LABELLED = re.compile(r"(?i)\b(?:passport|social security)\s+(?:no|nr|number)?[.:#]?\s*([A-Z0-9]{0,3}[0-9]{6,9}|[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9A-Za-z])")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")
#: What else may be one: letters, digits and a few marks, with a digit.
_ANY = re.compile(r"[A-Za-z0-9][A-Za-z0-9._/+-]*[A-Za-z0-9]={0,2}")
_DIGIT = re.compile(r"[0-9]")
_MARK = re.compile(r"[0-9@]")


def _emails(text: str) -> list[Span]:
    """Each @ with its local part before it; a run of local characters is walked once."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def _octets(text: str) -> bool:
    parts = [x.lstrip("0") for x in text.split(".")]
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in parts)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost spans of each kind; matches that fail their test are dropped, and nothing inside them is tried again."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _DIGIT.search(text):
        found["ip"] = [m.span() for m in _IP.finditer(text) if _octets(m[0])]
        found["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def _shape(token: str) -> str | None:
    """The kind that an identifier-like token could be of, by its characters and their tests alone."""
    digits = _digits(token)
    if "@" in token[1:-1]:
        return "email"
    if digits and not re.search(r"[^0-9 ().+/_:-]", token):
        if re.fullmatch(r"[0-9]{1,3}([.:-][0-9]{1,3}){3}", token):
            return "ip" if _octets(re.sub("[:-]", ".", token)) else None
        if 13 <= len(digits) <= 19:
            return "card" if _luhn(digits) else None
        return "phone" if 7 <= len(digits) <= 12 else None
    return None


def _inside(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """What may be an identifier in a dropped match, which ran on over its neighbours: the longest valid run of its first words
    for a phone, the first valid word for a card."""
    ends = [m.end() for m in re.finditer(r"[^ ]+", text[a:b])]
    starts = [m.start() for m in re.finditer(r"[^ ]+", text[a:b])]
    if kind == "phone":
        return next(((a, a + e) for e in reversed(ends) if 8 <= len(_digits(text[a : a + e])) <= 15), None)
    return next(((a + i, a + e) for i, e in zip(starts, ends, strict=True) if 16 <= len(d := _digits(text[a + i : a + e])) <= 19 and _luhn(d)), None)


def _several(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what may be identifiers in several words, outside the spans ``taken`` (sorted): at each word the longest
    valid run, unless each word is valid by itself; and addresses that spell out the @ or the dots."""
    found, nth = [], 0

    def free(a: int, b: int) -> bool:
        nonlocal nth
        while nth < len(taken) and taken[nth][1] <= a:
            nth += 1
        return not any(x < b and a < y for x, y, _ in taken[max(0, nth - 4) : nth + 4])

    for m in _RUN.finditer(text) if _DIGIT.search(text) else ():
        words = [w.span() for w in re.finditer(r"[^ \t]+", text[m.start() : m.end()])]
        words = [(a + m.start(), b + m.start()) for a, b in words]
        i = 0
        while i < len(words):
            for j in range(min(len(words), i + WORDS), i + 1, -1):
                a, b = words[i][0], words[j - 1][1]
                run = text[a:b].rstrip(".,:;-/+_ ")
                while run.endswith(")") and run.count(")") > run.count("("):
                    run = run[:-1]
                n = len(digits := _digits(run))
                kind = "card" if 13 <= n <= 19 and _luhn(digits) else "phone" if 7 <= n <= 15 else None
                if kind and run.count("(") == run.count(")") and " " in run and not all(_shape(text[x:y].strip(".,;:()")) for x, y in words[i:j]) and free(a, a + len(run)):
                    found.append((kind, a, a + len(run)))
                    i = j - 1
                    break
            i += 1
    end = nth = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start() and (host := _HOST.match(text, m.end())) and free(start, host.end()):
            end = host.end()
            found.append(("email", start, end))
    return found


def _iban(text: str) -> bool:
    """The check of bank numbers: letters count 10 to 35, the first four characters stand last, and the rest by 97 is 1."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def other_seeds(text: str) -> list[Span]:
    """Bank numbers that pass their check, numbers behind a telling label, private keys."""
    found = []
    if _DIGIT.search(text):
        found += [m.span() for m in _IBAN.finditer(text) if _iban(m[0])] + [m.span(1) for m in _LABELLED.finditer(text)]
    if "-----BEGIN " in text:
        found += [m.span() for m in _PEM.finditer(text)]
    return found


def _others(token: str) -> list[tuple[bool, int, int]]:
    """(seed, start, end) of the keys in a token, or of what may be an identifier there."""
    if keys := [(True, *m.span()) for m in _KEY.finditer(token)]:
        return keys
    if "@" in token or "://" in token:
        return []
    return [(False, *m.span()) for m in _ANY.finditer(token) if len(m[0]) >= 6 and len(_digits(m[0])) >= (1 if re.search("[A-Za-z]", m[0]) else 6)]


def _word(text: str) -> str:
    """A neighbour word as patterns have it: in lower case, each digit 0, no punctuation around; a very long one by its digest."""
    word = re.sub(r"[0-9]", "0", text.strip(".,;:!?()[]\"'").lower())
    return word if len(word) <= 64 else hashlib.sha256(word.encode()).hexdigest()


def _context(text: str, a: int, b: int) -> tuple[str, str, str]:
    """The word before a..b, the two before it, and the word after it; quotes and brackets that open right before it are none."""
    words, at = [], a
    while at > 0 and text[at - 1] in "\"'([{<":
        at -= 1
    for _ in range(2):
        while at > 0 and text[at - 1].isspace():
            at -= 1
        end = at
        while at > 0 and not text[at - 1].isspace():
            at -= 1
        words.append(_word(text[at:end]) if at < end else "^")
    while b < len(text) and text[b].isspace():
        b += 1
    end = b
    while end < len(text) and not text[end].isspace():
        end += 1
    return words[0], f"{words[1]} {words[0]}", _word(text[b:end]) if b < end else "$"


def occurrences(text: str) -> list[tuple[str, bool, int, int, str, str, str, str]]:
    """(kind, seed, start, end, instance, word before, two words before, word after) of the seeds, and of further
    tokens with digits or an @, and runs of them, outside those, that look like one of the kinds. Kind OTHER has seeds of its own; any
    further token with a digit may be one, wherever a trusted context says so."""
    base = base_spans(text)
    seeds = sorted((a, b, k) for k, spans in base.items() for a, b in spans)
    rows, end, nth = [(k, True, a, b) for a, b, k in seeds], 0, 0
    if _DIGIT.search(text):
        for kind, pattern in (("card", _CARD), ("phone", _PHONE)):
            own = {a for a, _ in base[kind]}
            for m in pattern.finditer(text) if kind == "card" or "+" in text else ():
                if m.start() not in own and len(_digits(m[0])) > 15 and (span := _inside(text, *m.span(), kind)):
                    if not any(a < span[1] and span[0] < b for a, b, _ in seeds):
                        rows.append((kind, False, *span))
    seeds = sorted((a, b, k) for k, _, a, b in rows)
    others = {x: True for x in other_seeds(text)}
    for m in _MARK.finditer(text) if "@" in text or _DIGIT.search(text) else ():
        if m.start() < end:
            continue
        a = b = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        end = b
        while nth < len(seeds) and seeds[nth][1] <= a:
            nth += 1
        if any(x < b and a < y for x, y, _ in seeds[max(0, nth - 4) : nth + 4]):
            continue
        token = text[a:b]
        for seed, x, y in _others(token):
            others.setdefault((a + x, a + y), seed)
        a += len(token) - len(token.lstrip(".,;:!?([{\"'<"))
        token = token.strip(".,;:!?()[]{}\"'<>")
        if kind := _shape(token):
            rows.append((kind, False, a, a + len(token)))
    rows += [(kind, False, a, b) for kind, a, b in _several(text, seeds)]
    rows += [(OTHER, seed, a, b) for (a, b), seed in others.items()]
    return [(kind, seed, a, b, text[a:b].lower(), *_context(text, a, b)) for kind, seed, a, b in rows]


@dataclass(frozen=True)
class Bootstrap:
    """A pattern is trusted from ``support`` different known instances on, if they are at least ``precision`` of all
    instances of that shape that it meets; an instance from a noisy-or of ``confidence`` over its patterns on."""

    support: int = 5
    precision: float = 0.8
    confidence: float = 0.9


_OCC = "array<struct<kind:string,seed:boolean,start:long,stop:long,instance:string,left1:string,left2:string,right1:string>>"


_FIELDS = ("kind", "seed", "start", "stop", "instance", "left1", "left2", "right1")
_ROWS = pa.list_(pa.struct(list(zip(_FIELDS, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), *[pa.string()] * 4), strict=True))))


def _found(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(_FIELDS, x, strict=True)) for x in occurrences(t)] if t else [] for t in texts.to_pylist()], _ROWS)


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column(0), _found(batch.column(1))], names=["doc_id", "occ"])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"doc_id long, occ {_OCC}")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder, whose size Spark knows when it plans a join: a small one is broadcast, a large one isn't."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discover(occ: DataFrame, rules: Bootstrap = Bootstrap()) -> DataFrame:
    """(kind, instance) that patterns find, from rows (kind, seed, instance, left1, left2, right1).

    The graph's edges join lexical patterns (the word before; the two before; the words on both sides) to the instances that fill
    them, each once; of numbers, their own digit mask is one more. Each round scores patterns by the share of known instances among
    their fillers, then instances by their trusted patterns; instances found serve as seeds of the next, until a round finds none.
    """
    patterns = F.array(F.concat(F.lit("1 "), "left1"), F.concat(F.lit("2 "), "left2"), F.concat(F.lit("3 "), "left1", F.lit(" _ "), "right1"), F.when(~F.col("kind").isin("email", OTHER), F.concat(F.lit("4 "), F.regexp_replace("instance", "[0-9]", "0"))))
    dealt = F.pmod(F.xxhash64("instance"), F.lit(SALTS)).cast("int").alias("salt")
    edges = cut(occ.select("kind", "instance", F.explode(patterns).alias("pattern")).filter("pattern IS NOT NULL").distinct().withColumn("salt", dealt))
    known = occ.filter("seed").select("kind", "instance").distinct()
    fillers = edges.groupBy("kind", "pattern").agg(F.count("*").alias("n"))
    found = None
    while True:
        hits = edges.join(known, ["kind", "instance"], "left_semi").groupBy("kind", "pattern").agg(F.count("*").alias("hits"))
        trusted = hits.filter(F.col("hits") >= rules.support).join(fillers, ["kind", "pattern"]).filter(F.col("hits") >= rules.precision * F.col("n"))
        trusted = _written(trusted.select("kind", "pattern", (F.col("hits") / (F.col("n") + 1)).alias("p")), "trusted")
        salted = trusted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a frequent word's instances are dealt to many tasks
        scored = edges.join(salted, ["kind", "pattern", "salt"]).groupBy("kind", "instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score"))
        new = _written(scored.filter(F.col("score") >= rules.confidence).join(known, ["kind", "instance"], "left_anti").select("kind", "instance"), "instances")
        found = new if found is None else found.unionByName(new)
        if new.isEmpty():
            break
        known = cut(known.unionByName(new))
    return _written(found, "found")


def _outer(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without the spans inside another one of their kind."""
    out: list[tuple[str, int, int]] = []
    for x in sorted(set(spans), key=lambda x: (x[0], x[1], -x[2])):
        if not (out and out[-1][0] == x[0] and x[2] <= out[-1][2]):
            out.append(x)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, OTHER))}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda x: (order[x[0]], x[1], x[2])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Bootstrap = Bootstrap()) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans) for every row of ``docs``.

    The texts are scanned once, without a shuffle; what goes on are the seeds and the tokens, or up to six in a row, that look like
    one, with the words around them. The counts and base_sha256 are of the base spans; ``spans`` has those and,
    outside them, every occurrence of an instance that :func:`discover` finds, and the identifiers of kind OTHER, which stand last
    (n_found of them; n_spans in all). Null and empty
    texts have none. Repeated rows, and rows without an id, are scanned each. Further columns aren't read; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "personal")
    _scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    occ = rows.select("row", F.explode("occ").alias("o")).select("row", "o.*")
    found = occ.filter("not seed").join(discover(occ, rules), ["kind", "instance"], "left_semi")
    extra = found.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("extra"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, occ, extra in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seeds = [(x["kind"], x["start"], x["stop"]) for x in occ if x["seed"]]
                base = [x for x in seeds if x[0] != OTHER]
                more = _outer([(x["kind"], x["start"], x["stop"]) for x in extra or []] + [x for x in seeds if x[0] == OTHER])
                n = [sum(x[0] == k for x in base) for k in KINDS]
                out.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(base + more), len(more), len(base) + len(more)))
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_found", "n_spans"]
            types = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 9, types, strict=True)], names=names)

    joined = rows.join(extra, "row", "left").select("doc_id", "occ", "extra")
    return joined.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long, n_spans long")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", rules: Bootstrap = Bootstrap()) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets, in all rows and with all columns.

    Overlapping spans are replaced as one, by the kind of the first. The length column, if it is
    there, follows the new text. Rows are written once with what the scan found in them; texts without a candidate stay where they
    are, and only those with one are joined to the spans that context confirms, by a number of the row. Null texts stay null, empty ones
    empty; each of repeated rows is replaced; rows need no id; columns may have any names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, length = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else -1
    plain = docs.toDF(*names)
    columns = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in plain.schema.fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[text]):
            yield pa.RecordBatch.from_arrays([*batch.columns, _found(batch.column(text))], names=[*names, "occ"])

    rows = _written(plain.mapInArrow(scan, f"{columns}, occ {_OCC}").withColumn("__row", F.monotonically_increasing_id()), "scanned")
    occ = rows.select("__row", F.explode("occ").alias("o")).select("__row", "o.*")
    hits = occ.filter("NOT seed").join(discover(occ, rules), ["kind", "instance"], "left_semi")
    extra = _written(hits.groupBy("__row").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("extra")), "extra")
    open_ = F.exists("occ", lambda x: ~x["seed"])
    sure = rows.filter(~open_).withColumn("extra", F.lit(None).cast("array<struct<kind:string,start:long,stop:long>>"))
    marked = rows.filter(open_).join(extra, "__row", "left").select(sure.columns).unionByName(sure)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, names[text]):
            new = []
            for t, occ, extra in zip(*(batch.column(i).to_pylist() for i in (text, len(names), len(names) + 1)), strict=True):
                new.append(t and _replace(t, [(x["start"], x["stop"], x["kind"]) for x in occ if x["seed"]] + [(x["start"], x["stop"], x["kind"]) for x in extra or ()]))
            columns = [pa.array(new, pa.string()) if i == text else pa.array([x if x is None else len(x) for x in new], pa.int64()).cast(batch.column(i).type) if i == length else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return marked.select(*names, "occ", "extra").mapInArrow(run, plain.schema).toDF(*docs.columns)


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    parts, end = [], 0
    for a, b, kind in sorted(spans):
        if a >= end:
            parts += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*parts, text[end:]])


def op5_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
