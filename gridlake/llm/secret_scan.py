"""Secret scans with multipart credential linking, as DataFrame expressions only.

Base findings are the matches of three patterns (BASE). Besides, weak parts are
looked for that mean nothing alone: key identifiers and user names, secrets of
40 characters, and endpoints (WEAK). A weak part is reported only if what it
lacks stands in its scope, the SCOPE code points before and after its start:
an identifier needs a secret, a secret needs an identifier, an endpoint needs
both. AKIA identifiers count as identifiers, assigned values and hex strings as
secrets.

Places of matches come from the lengths of the texts between them, summed by a
window over the matches of a row. The interval join deals parts to bins of SCOPE
code points: for each bin the nearest place of a role to the left, within and to
the right is kept by partial aggregation, and a weak part meets only the row of
its own bin. So no pairs of parts are made, however many share a scope. The parts
found are written to the shared folder, as three branches of the plan read them.

Defined results: a null or empty text has no findings; matches are leftmost and
do not overlap within their kind, case-insensitive for ASCII letters only;
repeated rows report the same, each for itself; the id may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .run import cut

SCOPE = 256

_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: (kind, pattern, least length of the last group or of the match) of base findings (fixed values).
BASE = [
    ("assign", _ASSIGN, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 20),
    ("hex", r"([0-9a-f]+)", 24),
]
#: Weak parts: (kind, pattern, least length of the last group).
WEAK = [
    ("ident", r"""(?i:access_?key_?id|client_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 3),
    ("secret40", r"(?<![A-Za-z0-9+/])([A-Za-z0-9+/]{40})(?![A-Za-z0-9+/=])", 40),
    ("endpoint", r"""(?i:https?://|endpoint["']?\x20*[:=]\x20*["']?|host["']?\x20*[:=]\x20*["']?)([A-Za-z0-9._:/-]+)""", 4),
]
KINDS = [*BASE, *WEAK]
#: A hex string is found by its own length at once: shorter runs cannot hold it.
_FAST = {"hex": r"([0-9a-f]{24,})", "access": r"(AKIA[A-Z0-9]{16,})"}
_ANY = r"""(?i:password|passwd|secret|token|api_?key|access_?key_?id|client_?id|user_?name|user|login|endpoint|host)["']?\x20*[:=]|(?i:https?://)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[A-Za-z0-9+/]{40}"""
#: What each kind is, and what has to be in its scope.
ROLE = {"assign": "secret", "hex": "secret", "secret40": "secret", "access": "ident", "ident": "ident"}
NEEDS = {"ident": ("secret",), "secret40": ("ident",), "endpoint": ("ident", "secret")}
_PART = "struct<kind:string,at:int,gap:int,len:int,value:int>"


def _matches(kind: str, pattern: str) -> Column:
    """The matches of a kind in _text: their order, the code points before them, their length and their value's."""
    regex = F.lit(_FAST.get(kind, pattern))
    gaps = F.transform(F.split(F.col("_text"), _FAST.get(kind, pattern), -1), F.length)
    whole, value = F.regexp_extract_all("_text", regex, F.lit(0)), F.regexp_extract_all("_text", regex, F.lit(1))
    return F.transform(
        F.arrays_zip(whole.alias("m"), value.alias("v"), F.slice(gaps, 1, F.size(whole)).alias("g")),
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), x["g"].alias("gap"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("value")),
    )


def parts(df: DataFrame, text: str, key: list[str]) -> DataFrame:
    """(key..., kind, start, end) of every match long enough, base or weak, once for equal rows."""
    rows = df.select(*key, F.col(text).alias("_text")).where(F.col("_text").rlike(_ANY))
    found = rows.select(*key, F.explode(F.concat(*[_matches(k, p) for k, p, _ in KINDS])).alias("p")).select(*key, "p.*").distinct()
    before = Window.partitionBy(*key, "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    least = F.create_map(*[F.lit(x) for k, _, n in KINDS for x in (k, n)])
    end = F.sum(F.col("gap") + F.col("len")).over(before)
    placed = found.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    return placed.where(F.col("value") >= least[F.col("kind")]).select(*key, "kind", "start", "end")


def link(found: DataFrame, key: list[str], scope: int = SCOPE) -> DataFrame:
    """The base parts, and the weak parts whose complements are in their scope."""
    role = F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair])[F.col("kind")]
    base = F.col("kind").isin([k for k, _, _ in BASE])
    strong = found.select(*key, role.alias("role"), "start", F.floor(F.col("start") / scope).alias("own")).where("role IS NOT NULL")
    dealt = strong.withColumn("bin", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))

    def nearest(role: str) -> list[Column]:
        on = F.col("role") == role
        return [
            F.max(F.when(on & (F.col("own") < F.col("bin")), F.col("start"))).alias(f"{role}_left"),
            F.max(F.when(on & (F.col("own") == F.col("bin")), F.lit(1))).alias(f"{role}_in"),
            F.min(F.when(on & (F.col("own") > F.col("bin")), F.col("start"))).alias(f"{role}_right"),
        ]

    bins = dealt.groupBy(*key, "bin").agg(*nearest("ident"), *nearest("secret"))

    def near(role: str) -> Column:
        return F.coalesce(
            F.col(f"{role}_in").isNotNull() | F.coalesce(F.col("start") - F.col(f"{role}_left") <= scope, F.lit(False)) | F.coalesce(F.col(f"{role}_right") - F.col("start") <= scope, F.lit(False)),
            F.lit(False),
        )

    complete = F.lit(False)
    for kind, needs in NEEDS.items():
        ok = F.col("kind") == kind
        for role_needed in needs:
            ok = ok & near(role_needed)
        complete = complete | ok
    weak = found.where(~base).withColumn("bin", F.floor(F.col("start") / scope))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*key, "bin"]]
    linked = weak.alias("w").join(bins.alias("b"), same).where(complete).select(*[F.col(f"w.{k}").alias(k) for k in [*key, "kind", "start", "end"]])
    return found.where(base).unionByName(linked)


def scan(df: DataFrame, text: str = "text", id: str = "doc_id", scope: int = SCOPE) -> DataFrame:
    """(id, spans) of each row; spans: array of (start, order of the kind, kind, end), sorted."""
    rows = df.select(F.col(id).alias("id"), F.col(text).alias("text")).withColumn("_h", F.xxhash64("text")).withColumn("_n", F.length("text"))
    key = ["id", "_h", "_n"]
    order = F.create_map(*[x for i, (k, _, _) in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])[F.col("kind")]
    found = cut(parts(rows, "text", key))  # the texts are searched once; base, weak and strong parts are read from there
    spans = link(found, key, scope).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "kind", "end"))).alias("spans"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    none = F.array().cast("array<struct<start:long,order:int,kind:string,end:long>>")
    return rows.select(*key).alias("r").join(spans.alias("s"), same, "left").select(F.col("r.id").alias("id"), F.coalesce(F.col("spans").cast("array<struct<start:long,order:int,kind:string,end:long>>"), none).alias("spans"))
