"""PII spans by weak supervision.

1. A permissive scan proposes candidate spans: addresses with @, IP addresses, runs of digits with
   separators, long tokens of letters and digits, and whatever follows a key word and an equals sign.
2. Labelers vote on each candidate: regular expressions on the span, gazetteers of domains, card
   prefixes and key words, and words of its context. A labeler may abstain.
3. Expectation-maximisation (Dawid and Skene, 1979) estimates each labeler's confusion matrix and the
   class shares from how often each combination of votes occurs in the whole corpus. Combinations
   are counted in Spark; there are no more than the labelers allow, however large the corpus.
4. A softmax classifier on features of span and context learns the posteriors, from a bounded sample
   of candidates, and labels every candidate. What it calls NONE is not PII.
"""

from __future__ import annotations

import ipaddress
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import _common as c

CLASSES = ("NONE", "EMAIL", "PHONE", "IP", "CARD", "SSN", "SECRET")
NONE, EMAIL, PHONE, IP, CARD, SSN, SECRET = range(len(CLASSES))
ABSTAIN = -1
#: Bound of the sample (candidates) that trains the span classifier; EM uses the counts of all.
SAMPLE, EM_ROUNDS, EPOCHS, BITS, CONTEXT = 20_000, 40, 12, 13, 24

# Each pattern starts only where a run of its characters starts and is possessive or of fixed size, so that the
# scan is linear; none bounds the length of what it finds.
#: Spans of a known form.
_FORMS = re.compile(
    r"(?P<mail>(?<![\w.+%-])[\w.+%-]++@\w(?:[\w-]*+)(?:\.[\w-]++)++)"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))"
    r"|(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*::|(?:[0-9A-Fa-f]{1,4}:){7})[0-9A-Fa-f:]++(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3})?(?![\w:]))"
    r"|(?P<card>(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4})(?!\w))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+?[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w))"
    r"|(?P<mixed>(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+)"
)
#: Runs of digits with separators, between those.
_DIGITS = re.compile(r"(?<![\w.])\+?\(?[0-9](?:[0-9]|[ .()\-/](?=[ .()\-/]?[0-9(])){5,}+")
#: What a key word and an equals sign or colon lead to is a candidate whatever it looks like.
_VALUE = re.compile(r"(?i)(?:passw(?:or)?d|pwd|token|secret|api[_-]?key|access[_-]?key|bearer)[ \t]?(?:(=)|:)[ \t]?[\"']?([^\s\"'<>,;]++)")
#: A text without any of these has no candidate.
_HINT = re.compile(r"[0-9@]|::|(?i:passw|pwd|token|secret|key|bearer)")
_TLD = frozenset("com org net edu gov io de fr es uk info biz co us eu example invalid test local".split())
_ISSUER = re.compile(r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")
_WORDS = {
    EMAIL: frozenset("email mail e-mail contact write mailto".split()),
    PHONE: frozenset("phone call tel telephone fax mobile cell".split()),
    IP: frozenset("ip server host node router client".split()),
    CARD: frozenset("card visa mastercard credit payment iban".split()),
    SSN: frozenset("ssn social security".split()),
    SECRET: frozenset("password passwd pwd token secret key apikey api_key bearer".split()),
    NONE: frozenset("version v release isbn issn doi figure table page pages year".split()),
}
_SECRET_LEAD = re.compile(r"(?i)(?:passw(?:or)?d|pwd|token|secret|api[_-]?key|access[_-]?key|bearer)\s{0,4}[=:]?\s{0,4}[\"']?$")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octets(s: str) -> bool:
    p = s.split(".")
    return len(p) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) < 256 for x in p)


def _ip6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def votes(span: str, before: str, after: str) -> list[int]:
    """One vote (class or ABSTAIN) of each labeler."""
    digits = re.sub(r"[^0-9]", "", span)
    bare = not re.search(r"[A-Za-z@]", span)
    near = frozenset(re.findall(r"[a-z_-]+", (before + " " + after).lower()))
    lead = _SECRET_LEAD.search(before) is not None
    out = []
    # regular expressions
    address = span.count("@") == 1 and re.fullmatch(r"[\w.+%-]+@(?:[\w-]+\.)+[^\W\d_]{2,24}", span)
    colons = span.count(":") > 1
    out.append(EMAIL if address else NONE if "@" in span and not lead else ABSTAIN)
    out.append(IP if _octets(span) or colons and _ip6(span) else NONE if (bare and span.count(".") == 3 and len(span.split(".")) == 4 or colons) and not lead else ABSTAIN)
    out.append(PHONE if bare and re.fullmatch(r"(?:\+?\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]?\d{4}", span) else ABSTAIN)
    out.append(PHONE if bare and span.startswith("+") and 8 <= len(digits) <= 15 else ABSTAIN)
    out.append(SSN if re.fullmatch(r"\d{3}-\d{2}-\d{4}", span) else ABSTAIN)
    out.append((CARD if luhn(digits) else ABSTAIN) if bare and 13 <= len(digits) <= 19 and "." not in span else ABSTAIN)
    out.append(CARD if bare and re.fullmatch(r"\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}", span) else ABSTAIN)
    out.append(SECRET if re.fullmatch(r"[0-9a-f]{16,}|[0-9A-Za-z_-]{20,}", span) and not bare else ABSTAIN)
    out.append(NONE if bare and (len(digits) < 8 or len(digits) > 19) and not _octets(span) and not lead else ABSTAIN)
    # gazetteers
    out.append(EMAIL if "@" in span and span.rpartition(".")[2].lower() in _TLD else ABSTAIN)
    out.append(CARD if bare and len(digits) in (15, 16) and _ISSUER.match(digits) and "." not in span else ABSTAIN)
    # context
    out.append(SECRET if lead and not (bare and len(span) < 6) and not address else ABSTAIN)
    for kind in (EMAIL, PHONE, IP, CARD, SSN, SECRET, NONE):
        out.append(kind if near & _WORDS[kind] else ABSTAIN)
    return out


N_LABELERS = 19


def features(span: str, before: str, after: str) -> list[int]:
    """Hashes of features: shape, digits, separators, length, start, key word ahead, neighbouring words and characters."""
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]", "9", span)))[:40]
    run = re.sub(r"9+", "9", shape)
    n = sum(map(str.isdigit, span))
    left = re.findall(r"[^\W\d]+", before.lower())[-2:]
    right = re.findall(r"[^\W\d]+", after.lower())[:1]
    raw = [f"s:{shape}", f"r:{run}", f"n:{min(n, 64)}", f"l:{min(len(span), 48)}", f"p:{span[:1] if not span[:1].isalnum() else ''}", f"o:{_octets(span)}", f"@:{'@' in span}", f"b:{before[-1:]}", f"i:{bool(_ISSUER.match(span))}"]
    raw += [f"k:{_SECRET_LEAD.search(before) is not None}", f"6:{span.count(':') > 1 and _ip6(span)}"]
    return [crc32(r.encode()) for r in raw + [f"w:{w}" for w in left] + [f"x:{w}" for w in right]]


def buckets(hashes: list[list[int]]) -> list[list[int]]:
    """The feature buckets of rows of hashes."""
    at = np.cumsum([0, *map(len, hashes)])
    flat = (c.mix(np.array([h for row in hashes for h in row], np.uint64)) >> np.uint64(64 - BITS)).astype(int).tolist()
    return [flat[a:b] for a, b in zip(at, at[1:])]


def _spans(text: str):
    """(start, end) of candidates, left to right, not overlapping: values after a key word, then known forms, then digits."""
    found = []
    for m in _VALUE.finditer(text):
        a, b = m.span(2)
        # a colon leads to prose too: there only what no plain word is
        if m.group(1) or not text[a:b].rstrip(".!?)").isalpha() or b - a >= 12:
            found.append((a, b))
    at = 0
    for a, b in [*found, (len(text), len(text))]:
        here = at
        for m in _FORMS.finditer(text, at, a):
            if m.lastgroup == "mixed" and not (re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group())):
                continue
            yield from (d.span() for d in _DIGITS.finditer(text, here, m.start()))
            yield m.span()
            here = m.end()
        yield from (d.span() for d in _DIGITS.finditer(text, here, a))
        if a < b:
            yield a, b
        at = b


def candidates(text: str):
    """(start, end, span, before, after) in characters of the text, left to right, not overlapping."""
    for a, b in _spans(text):
        cut = text[a:b].rstrip(".-_()/ ")
        if any(map(str.isalnum, cut)):
            yield a, a + len(cut), cut, text[max(0, a - CONTEXT) : a], text[a + len(cut) : a + len(cut) + CONTEXT]


def _candidate_batches(batches):
    names = ["doc_id", "start", "end", "span", "pattern", "features"]
    for batch in batches:
        rows = {n: [] for n in names}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not _HINT.search(text):
                continue
            for a, b, span, before, after in candidates(text):
                values = (doc, a, b, span, ",".join(map(str, votes(span, before, after))), features(span, before, after))
                for n, v in zip(names, values):
                    rows[n].append(v)
        rows["features"] = buckets(rows["features"])
        yield pa.RecordBatch.from_arrays([pa.array(rows[n], k) for n, k in zip(names, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())))], names)


def dawid_skene(patterns: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each pattern, confusion[labeler, class, vote], class shares) by EM; not to
    vote is an outcome too. Starts from the majority of the votes; no votes at all start as NONE."""
    k, (n, m) = len(CLASSES), patterns.shape
    post = np.full((n, k), 1e-3)
    for v in range(k):
        post[:, v] += (patterns == v).sum(1)
    post[(patterns == ABSTAIN).all(1), NONE] += 1
    post /= post.sum(1, keepdims=True)
    for _ in range(rounds):
        w = post * counts[:, None]
        share = (w.sum(0) + 0.1) / (w.sum() + 0.1 * k)
        conf = np.zeros((m, k, k + 1))  # the last outcome is ABSTAIN, index -1
        log = np.log(share)[None].repeat(n, 0)
        for j in range(m):
            for v in range(-1, k):
                conf[j, :, v] = w[patterns[:, j] == v].sum(0)
            conf[j] += 0.05
            conf[j, range(k), range(k)] += 0.5  # labelers are taken to be better than chance
            conf[j] /= conf[j].sum(1, keepdims=True)
            log += np.log(conf[j][:, patterns[:, j]]).T
        post = np.exp(log - log.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    return post, conf, share


def train_spans(feats: list[list[int]], soft: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> np.ndarray:
    """Weights (features + 1 bias, classes) of a softmax classifier of soft labels."""
    w = np.zeros(((1 << BITS) + 1, len(CLASSES)))
    ada = np.full(len(w), 1e-2)
    rng = np.random.default_rng(seed)
    rows = [np.append(np.unique(f), 1 << BITS) for f in feats]
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            z = w[rows[i]].sum(0)
            p = np.exp(z - z.max())
            g = p / p.sum() - soft[i]
            ada[rows[i]] += g @ g
            w[rows[i]] -= 0.3 * g / np.sqrt(ada[rows[i]])[:, None]
    return w


def classify_spans(w: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    z = np.stack([w[np.append(np.unique(f), 1 << BITS)].sum(0) for f in feats]) if len(feats) else np.zeros((0, len(CLASSES)))
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find_pii(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, start, end, kind, score, span): every span that is PII; start and end in characters.

    NULL and empty texts have none; long texts are searched whole, and a span may be of any length; a NULL doc_id
    stays NULL; rows that repeat are each searched; ties go to the earlier class; an empty table and one without
    candidates give no rows. Other columns, whatever their names, are ignored.
    """
    found = c.materialize(spark, c.id_text(docs).mapInArrow(_candidate_batches, "doc_id bigint, start bigint, end bigint, span string, pattern string, features array<int>"))
    counted = found.groupBy("pattern").count().toPandas().sort_values("pattern")
    schema = "doc_id bigint, start bigint, end bigint, kind string, score double, span string"
    if not len(counted):
        return spark.createDataFrame([], schema)
    patterns = np.array([[int(x) for x in p.split(",")] for p in counted["pattern"]])
    post, _, _ = dawid_skene(patterns, counted["count"].to_numpy(float))
    known = dict(zip(counted["pattern"], post))
    # the least hashes; what lies clearly beyond them never leaves its task
    most = min(1.0, (sample + 6 * sample**0.5) / float(counted["count"].sum()))
    hashed = found.select("pattern", "features", F.xxhash64("doc_id", "start", "span").alias("h")).where(F.col("h") <= min(2**63 - 1, int((2 * most - 1) * 2**63)))
    chosen = hashed.orderBy("h").limit(sample).toPandas()
    weights = spark.sparkContext.broadcast(train_spans(chosen["features"].tolist(), np.stack([known[p] for p in chosen["pattern"]])))
    del known

    def run(batches):
        for batch in batches:
            p = classify_spans(weights.value, batch.column("features").to_pylist())
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            out = pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("doc_id", "start", "end")), pa.array(np.array(CLASSES, object)[best], pa.string()), pa.array(p.max(1) if len(p) else np.zeros(0)), batch.column("span")],
                ["doc_id", "start", "end", "kind", "score", "span"],
            )
            yield out.filter(pa.array(best != NONE))

    return found.mapInArrow(run, schema)
