"""Personal data by weak supervision.

Candidates are spans that patterns propose: the base kinds (BASE) and wider
forms. Labelers vote on each for (1), against (-1) or not at all (0): the
pattern's own check, a gazetteer (mail domains, country codes, card issuers,
address ranges), the words before the span, and its form. Expectation
maximisation over the counts of all vote patterns in the corpus estimates each
labeler's reliability for each kind of value and the share of true spans. The
posteriors are the targets of a logistic span classifier, which decides. It sees
the kind, the votes, and the span itself: its length, its separators and digits,
and the characters beside it. So what the labelers say of most spans of a shape
bears on those of that shape on which they are silent. Counts of the patterns of
votes and shapes are made by a distributed aggregation; the alphabet of both
bounds them (some thousands occur), however many documents there are, and only
they reach the driver.

Base findings always stay; the classifier adds other candidates with a score of
THRESHOLD or more that overlap no base finding.

Defined results: a null or empty text has no spans; base matches are leftmost
and do not overlap within their kind, a match that fails its check is dropped
without another try (it stays a candidate, though); repeated rows report the
same; an empty table trains nothing and reports nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.5
ROUNDS = 50

#: Base kinds in the order of reports (fixed patterns).
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # a match never begins within a run of digits; said so, long runs cost no second look
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Other candidates, found besides.
WIDER = {
    "email_spelled": re.compile(r"[A-Za-z0-9._%+-]{2,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]+(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]+)+"),
    "phone_local": re.compile(r"(?<![0-9+.)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
}
KINDS = [*BASE, *WIDER]
LABELERS = ("check", "gazetteer", "context", "form")

#: Gazetteers (fixed values): mail endings, country codes of one to three digits, first digits of card issuers.
MAIL_ENDINGS = set("com org net edu gov io co uk de fr es it nl eu ch at be us ca au".split())
COUNTRY_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 370 371 372 380 385 386 420 421 852 886 966 971 972".split())
CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "62", "65")
CONTEXT_FOR = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "address", "host", "server", "from"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "ssn": ("ssn", "social", "security"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
CONTEXT_AGAINST = ("version", "isbn", "issn", "doi", "order", "invoice", "sku", "item", "section", "figure", "page", "id")
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    """The check of a base kind or a wider one."""
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "ssn":
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "iban":
        plain = found.replace(" ", "")
        return len(plain) >= 15 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    return True


def _gazetteer(kind: str, found: str) -> int:
    if kind.startswith("email"):
        return 1 if re.split(r"\W+", found.rstrip(")]"))[-1].lower() in MAIL_ENDINGS else 0
    if kind == "phone":
        lead = re.match(r"\+([0-9]{1,3})", found)[1]
        return 1 if any(lead[:n] in COUNTRY_CODES for n in (1, 2, 3)) else -1
    if kind == "card":
        return 1 if re.sub("[^0-9]", "", found).startswith(CARD_STARTS) else -1
    if kind == "ip":
        first = found.split(".")[0].lstrip("0")
        return -1 if first in ("", "127", "255") or len(first) > 3 or int(first) > 223 else 1
    return 0


def _context(kind: str, text: str, start: int) -> int:
    words = {w.lower() for w in _WORD.findall(text[max(0, start - 40) : start])}
    near = any(w in words for w in CONTEXT_FOR[kind.split("_")[0]])
    return 1 if near else -1 if words & set(CONTEXT_AGAINST) else 0


def _form(kind: str, text: str, start: int, end: int) -> int:
    if (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return -1
    found = text[start:end]
    if kind == "card":
        sizes = {len(x) for x in re.split("[ -]", found)}
        return 1 if len(sizes) == 1 and sizes <= {4, *range(14, 20)} else -1 if 1 in sizes else 0
    if kind == "phone":
        return 1 if found.count("(") == found.count(")") and not re.search("[.-]{2}", found) else -1
    return 1


def shape(text: str, start: int, end: int) -> str:
    """Five characters: what stands before and after (^ nothing, s space, w letter or digit, p other), length, separators, share of digits."""
    beside = (text[start - 1 : start], text[end : end + 1])
    ends = "".join("^" if not c else "s" if c.isspace() else "w" if c.isalnum() else "p" for c in beside)
    span = text[start:end]
    digits = sum(c.isdigit() for c in span)
    marks = len({c for c in span if not c.isalnum()})
    return f"{ends}{min(9, (end - start) // 5)}{min(3, marks)}{4 * digits // max(1, end - start)}"


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...]]]:
    """(kind, start, end, base, votes) of every candidate of a text."""
    out = []
    for kind, pattern in [*BASE.items(), *WIDER.items()]:
        if kind == "email" and "@" not in text or kind == "email_spelled" and "at]" not in text and "at)" not in text or kind == "phone" and "+" not in text:
            continue
        for m in _emails(text) if kind == "email" else pattern.finditer(text):
            a, b = m.span()
            if kind == "card" and b - a < 12:
                continue  # fewer than 12 digits: neither a finding nor a candidate
            ok = passes(kind, m[0])
            votes = (1 if ok else -1, _gazetteer(kind, m[0]), _context(kind, text, a), _form(kind, text, a, b))
            out.append((kind, a, b, ok and kind in BASE, votes))
    return out


def _emails(text: str) -> Iterator[re.Match]:
    """As finditer of the pattern, but begun at the local part before each @."""
    at, done = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > done and (text[begin - 1] in _LOCAL_CHARS):
            begin -= 1
        m = BASE["email"].match(text, begin) if begin < at else None
        if m:
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _votes_schema() -> T.StructType:
    return T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean").add("votes", "string").add("shape", "string")


#: A pattern: kind, votes, shape.
Pattern = tuple[str, str, str]


class Classifier:
    """A logistic classifier of spans by kind, votes and shape."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self._known = weights, {}

    @staticmethod
    def features(pattern: Pattern) -> list[str]:
        kind, votes, form = pattern
        return ["all", kind, *(f"vote {j}{c}" for j, c in enumerate(votes) if c != "0"), *(f"shape {j}{c}" for j, c in enumerate(form)), *(f"{kind} {j}{c}" for j, c in enumerate(form))]

    def score(self, pattern: Pattern) -> float:
        """0 to 1; without any training 0."""
        if pattern not in self._known:
            z = sum(self.weights.get(f, 0.0) for f in self.features(pattern))
            self._known[pattern] = 1 / (1 + np.exp(-np.clip(z, -30, 30))) if self.weights else 0.0
        return self._known[pattern]


def _scan(df: DataFrame, text: str, model: Classifier | None, name: str) -> DataFrame:
    """df with its candidates (model None), or with the spans that stand."""

    def of_text(t: str | None) -> list[dict]:
        t = t or ""
        found = [{"kind": k, "start": a, "end": b, "base": base, "votes": "".join("-0+"[v + 1] for v in votes), "shape": shape(t, a, b)} for k, a, b, base, votes in candidates(t)]
        if model is None:
            return found
        sure = [x for x in found if x["base"]]
        more = [x for x in found if not x["base"] and model.score((x["kind"], x["votes"], x["shape"])) >= THRESHOLD and not any(x["start"] < y["end"] and y["start"] < x["end"] for y in sure)]
        return sorted([*sure, *more], key=lambda x: (x["start"], KINDS.index(x["kind"])))

    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("shape", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([of_text(t) for t in batch[text].to_pylist()], spans)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(_votes_schema()))]))


def reliabilities(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    """Expectation maximisation: the probability that a candidate of each (kind, votes) is personal data.

    Starts from the majority of the votes; a labeler's votes given the truth are
    smoothed by prior votes toward better than chance. The check's prior grows with
    the candidates: a failed checksum is evidence, not one opinion among four.
    """
    out = {}
    for kind in sorted({k for k, _ in counts}):
        patterns = [(v, n) for (k, v), n in sorted(counts.items()) if k == kind]
        votes = np.array([["-0+".index(c) for c in v] for v, _ in patterns])
        n = np.array([c for _, c in patterns], float)
        belief = 1 / (1 + np.exp(-(votes - 1).sum(1)))
        prior = np.array([[[2, 1, 0.5], [0.5, 1, 2]]] * votes.shape[1])  # labeler, truth, vote
        prior[0] = np.array([[20, 1, 0.1], [0.1, 1, 20]]) * (1 + 0.1 * n.sum())
        for _ in range(ROUNDS):
            share = ((belief * n).sum() + 1) / (n.sum() + 2)
            table = prior.copy()
            for j in range(votes.shape[1]):
                for v in range(3):
                    on = votes[:, j] == v
                    table[j, 1, v] += (belief * n)[on].sum()
                    table[j, 0, v] += ((1 - belief) * n)[on].sum()
            table /= table.sum(2, keepdims=True)
            odds = np.log(share / (1 - share)) + sum(np.log(table[j, 1, votes[:, j]] / table[j, 0, votes[:, j]]) for j in range(votes.shape[1]))
            belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        out |= {(kind, v): float(b) for (v, _), b in zip(patterns, belief, strict=True)}
    return out


def classifier(counts: dict[Pattern, int], belief: dict[tuple[str, str], float], rounds: int = 3000) -> Classifier:
    """A span classifier trained on the beliefs by gradient descent; a pattern weighs the root of its count."""
    pairs = sorted(counts)
    names = sorted({f for p in pairs for f in Classifier.features(p)})
    place = {f: i for i, f in enumerate(names)}
    at = [np.array([place[f] for f in Classifier.features(p)]) for p in pairs]
    row, column = np.repeat(np.arange(len(pairs)), [len(x) for x in at]), np.concatenate([*at, np.zeros(0, np.int64)])
    y, n = np.array([belief[p[:2]] for p in pairs]), np.sqrt([float(counts[p]) for p in pairs])
    n, w = n / (n.sum() or 1), np.zeros(len(names))
    for _ in range(rounds if pairs else 0):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[column], len(pairs)), -30, 30)))
        w -= 0.4 * (np.bincount(column, (n * (p - y))[row], len(names)) + 1e-4 * w)
    return Classifier(dict(zip(names, w.tolist(), strict=True)))


def train(df: DataFrame, text: str = "text") -> Classifier:
    """The span classifier, from the patterns of all texts of df."""
    found = _scan(df.select(F.col(text).alias("text")).where(F.col("text").isNotNull()), "text", None, "found")
    rows = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count().collect()
    counts = {(r.kind, r.votes, r["shape"]): r["count"] for r in rows}
    by_votes: dict[tuple[str, str], int] = {}
    for (kind, votes, _), n in counts.items():
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    return classifier(counts, reliabilities(by_votes))


def find(df: DataFrame, scores: Classifier, text: str = "text", spans: str = "pii") -> DataFrame:
    """df with a new column of spans (kind, start, end, base, votes, shape), sorted by start and kind."""
    if spans in df.columns:
        raise ValueError(f"column name taken: {spans}")
    return _scan(df, text, scores, spans)


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """df of find() with each span, or run of overlapping ones, replaced by its first kind in brackets."""
    t, s = F.col(text), F.col(spans)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        s, start,
        lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], t.substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit("["), F.upper(x["kind"]), F.lit("]")).alias("out")))
        .otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(acc["out"], t.substr((acc["at"] + 1).cast("int"), F.length(t))),
    )
    return df.withColumn(text, F.when(F.size(s) > 0, done).otherwise(t))
