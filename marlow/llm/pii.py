"""Personal data: weak-supervision aggregation, in DataFrame operations only.

Base spans (email, ip, card, phone) come from fixed patterns. The method adds spans that patterns
alone cannot vouch for: quoted or assigned secrets, telephone numbers without a country code, and
names after a form of address. Three labelers vote on each candidate: a strict *regex*, a *gazetteer*
of cue words before it, and its *context* (punctuation around it). Counts of the vote patterns over
the whole corpus, a table of at most ``KINDS * 2**3 * 9`` rows, are all that reaches the driver; there
expectation-maximisation estimates each labeler's hit and false-alarm rate, and the posteriors train a
logistic span classifier on the votes and two shape features. Its weights go back into one column
expression, which judges every candidate.

Edge cases: a null text is empty and has no spans; offsets are code points, end exclusive; a document
that occurs twice gives two equal rows; a corpus without candidates trains nothing and adds no span;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import let, sums_before
from .store import materialise

# The patterns below match what the plain ones in BASE_PLAIN match; possessive quantifiers and
# look-behind only keep the engine from trying again inside a run that has already failed.
BASE_PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "secret": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+",
    "local_phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20\p{Lu}\p{L}++(?:\x20\p{Lu}\p{L}++)?",
}
STRICT = {"secret": r"^(?:[0-9a-f]{24,}|[A-Z0-9]{20}|(?:sk|pk|ghp|AKIA)[A-Za-z0-9_-]{12,})$", "local_phone": r"^\([0-9]{3}\)|^[0-9]{3}-", "name": r"\x20\p{Lu}\p{L}+\x20\p{Lu}"}
CUES = {"secret": r"(?i)(?:token|secret|password|passwd|api[_ -]?key|\bkey|auth)", "local_phone": r"(?i)(?:phone|tel|call|mobile|fax|contact)", "name": r"(?i)(?:name|contact|dear|author|signed|from)"}
AROUND = {"secret": r"[=:]\x20?[\"']?$", "local_phone": r"[:\x20(]$", "name": r"(?:^|[\n:,.]\x20?)$"}
CONTEXT_CHARS = 24


def _spans(text: Column, kind: str, pattern: str, order: int) -> Column:
    """array<struct(start, ord, end, kind, hit, before)> of the leftmost non-overlapping matches."""
    def spans(found: Column) -> Column:
        n = F.size(found["hits"])
        sizes = F.zip_with(found["hits"], found["gaps"], lambda hit, gap: F.coalesce(F.length(hit), F.lit(0)) + F.length(gap))
        placed = F.arrays_zip(F.slice(sums_before(sizes), F.lit(1), n).alias("before"), found["hits"].alias("hit"), F.slice(found["gaps"], F.lit(1), n).alias("gap"))
        return F.transform(placed, lambda x: _span(x, kind, order))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))
    none = F.expr("cast(array() as array<struct<start:int,ord:int,end:int,kind:string,hit:string,before:string>>)")
    return F.when(text.rlike(pattern), let(found, spans)).otherwise(none)


def _span(x: Column, kind: str, order: int) -> Column:
    start = x["before"] + F.length(x["gap"])
    return F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + F.length(x["hit"])).alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(CONTEXT_CHARS)).alias("before"))


def _luhn(digits: Column) -> Column:
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _valid_span(kind: str, s: Column) -> Column:
    return _valid(kind, s["hit"])


def _of_kind(kind: str, s: Column) -> Column:
    return s["kind"] == kind


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _votes(kind: str, s: Column) -> Column:
    share = F.length(F.regexp_replace(s["hit"], "[^0-9]", "")) / F.length(s["hit"])
    return F.struct(
        s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"),
        s["hit"].rlike(STRICT[kind]).cast("int").alias("v0"), s["before"].rlike(CUES[kind]).cast("int").alias("v1"), s["before"].rlike(AROUND[kind]).cast("int").alias("v2"),
        F.when(share < 0.2, 0).when(share < 0.7, 1).otherwise(2).alias("share"), F.when(F.length(s["hit"]) < 16, 0).when(F.length(s["hit"]) < 32, 1).otherwise(2).alias("size"),
    )


def estimate(cells: list[dict], rounds: int = 50, iterations: int = 300) -> dict[str, float]:
    """EM over the vote patterns of each kind, then logistic weights fitted to the posteriors.

    ``cells``: kind, v0..v2, share, size, rows - a bounded table of counts.
    """
    weights: dict[str, float] = {}
    for kind in sorted({c["kind"] for c in cells}):
        own = [c for c in cells if c["kind"] == kind]
        prior, hit, alarm = 0.5, [0.8] * 3, [0.2] * 3
        total = sum(c["rows"] for c in own)

        def posterior(c: dict) -> float:
            yes, no = prior, 1 - prior
            for j in range(3):
                yes *= hit[j] if c[f"v{j}"] else 1 - hit[j]  # noqa: B023
                no *= alarm[j] if c[f"v{j}"] else 1 - alarm[j]  # noqa: B023
            return yes / (yes + no)

        for _ in range(rounds):
            p = [posterior(c) for c in own]
            mass = sum(x * c["rows"] for x, c in zip(p, own, strict=True))
            on = [sum(x * c["rows"] for x, c in zip(p, own, strict=True) if c[f"v{j}"]) for j in range(3)]
            off = [sum((1 - x) * c["rows"] for x, c in zip(p, own, strict=True) if c[f"v{j}"]) for j in range(3)]
            prior = (mass + 1) / (total + 2)
            # Beta priors hold the rates away from 0 and 1 and keep "yes" the side that votes agree with.
            hit = [(x + 8) / (mass + 10) for x in on]
            alarm = [(x + 2) / (total - mass + 10) for x in off]
        target = [(c, posterior(c)) for c in own]
        names = ["bias", "v0", "v1", "v2", "share1", "share2", "size1", "size2"]
        w = dict.fromkeys(names, 0.0)
        for _ in range(iterations):
            step = dict.fromkeys(names, 0.0)
            for c, y in target:
                x = _features(c)
                err = (y - 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))) * c["rows"] / total
                for k, v in x.items():
                    step[k] += err * v
            for k in names:
                w[k] += 2.0 * (step[k] - 1e-4 * w[k])
        weights |= {f"{kind}.{k}": v for k, v in w.items()}
    return weights


def _features(c: dict) -> dict[str, float]:
    return {"bias": 1.0, "v0": c["v0"], "v1": c["v1"], "v2": c["v2"], "share1": float(c["share"] == 1), "share2": float(c["share"] == 2), "size1": float(c["size"] == 1), "size2": float(c["size"] == 2)}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, base and all spans as arrays of struct(start, ord, end, kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    base = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        good = F.filter(_spans(F.col("text"), kind, pattern, order), partial(_valid_span, kind))
        base.append(F.transform(good, lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"])))
    extra = [F.transform(_spans(F.col("text"), kind, pattern, len(BASE) + i), partial(_votes, kind)) for i, (kind, pattern) in enumerate(EXTRA.items())]
    found = materialise(rows.select("doc_id", F.array_sort(F.concat(*base)).alias("base"), F.concat(*extra).alias("candidates")), "pii")

    cells = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.v0", "c.v1", "c.v2", "c.share", "c.size").agg(F.count(F.lit(1)).alias("rows"))
    weights = estimate(sorted((r.asDict() for r in cells.collect()), key=str))

    def score(s: Column) -> Column:
        z = F.lit(-100.0)
        for kind in EXTRA:
            if f"{kind}.bias" not in weights:
                continue
            w = {k: weights[f"{kind}.{k}"] for k in ("bias", "v0", "v1", "v2", "share1", "share2", "size1", "size2")}
            own = F.lit(w["bias"])
            for k in ("v0", "v1", "v2"):
                own = own + s[k] * w[k]
            for k in ("share", "size"):
                own = own + F.when(s[k] == 1, w[f"{k}1"]).when(s[k] == 2, w[f"{k}2"]).otherwise(0.0)
            z = F.when(s["kind"] == kind, own).otherwise(z)
        return z

    cut = math.log(threshold / (1 - threshold))
    overlaps = lambda s: F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("candidates", lambda s: (score(s) > cut) & ~overlaps(s))
    plain = F.transform(added, lambda s: F.struct(s["start"], s["ord"], s["end"], s["kind"]))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", plain)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """The columns that the query returns, from ``find_pii``'s spans."""
    n = [F.size(F.filter("base", partial(_of_kind, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
