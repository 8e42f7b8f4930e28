"""Personal-data spans by weak supervision, with DataFrame operations only.

Base spans follow fixed patterns and checks and always stay.  Candidates are
wider: all base matches (whether or not they pass their check), spelled-out
addresses, numbers without a plus sign, 13- to 15-digit cards, IPv6, and secrets
(a value assigned to a name, or a long run of letters and digits).  Five
labelers vote on each of them, yes, no or not at all: shape (regex), gazetteer
(suffixes, issuer and area prefixes, names of secrets), context (words before),
check (Luhn, ranges, digit counts, entropy) and neighbour (whether the document
has a candidate of another kind).  Expectation-maximisation over the counts of
vote patterns estimates each labeler's reliability per kind; base spans anchor it as
known positives, base matches that fail their check as known negatives.  Its
posteriors train the span classifier, a logistic regression on votes and on
features of the span's own (length, share of digits, variety of characters,
quoting), which decides on candidates beyond the base.

Votes and features are small integers, so what the driver sees is a count per
pattern, bounded by their number of combinations whatever the corpus.

Positions are code points.  A null text is empty; overlapping candidates give
way to base spans and to kinds listed earlier; repeated rows come back as often
as they came; without candidates nothing is added; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.storage import Scratch

#: Kinds with base spans, in the order of reports; added spans may be secrets as well.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Possessive forms and run starts match what the plain patterns match, in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[a-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[a-z0-9-]{1,63}+)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9+.][\x20-]?)[0-9](?:[\x20-]?[0-9]){12,14}(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9][\x20.-]?)(?<![A-Za-z+(.-])(?:00[0-9]{1,3}[\x20-])?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
WIDE_GATES = {
    "email": r"(?i)[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]", "card": r"[0-9](?:[\x20-]?[0-9]){12}",
    "phone": r"[0-9][\x20.-][0-9]{3}[\x20.-][0-9]{4}", "secret": r"[A-Za-z0-9+/_-]{20}",
}
#: Gazetteers and context words.
SUFFIXES = "com|org|net|edu|gov|io|de|fr|es|it|uk|eu|info|biz|example"
CONTEXT = {
    "email": r"(?i)(e-?mail|mail|correo|courriel|contact|kontakt)",
    "ip": r"(?i)(\bip\b|ipv6|address|adresse|host|server)",
    "card": r"(?i)(card|visa|amex|credit|tarjeta|carte|karte)",
    "phone": r"(?i)(phone|tel\b|tel\.|call|fax|mobile|móvil|telefon|tél)",
    "secret": r"""[=:]\s*["']?$""",
}
GAZETTEER = {
    "email": rf"(?i)(\.|dot[\])]\x20?)({SUFFIXES})$", "ip": r"(?i)^((2[0-9a-f]{3}|fe80|fd[0-9a-f]{2}):|[1-9][0-9]{0,2}\.)", "card": r"^(3[47]|4|5[1-5]|6)", "phone": r"^(\+|\(?[2-9][0-9]{2}\)?|00)",
    "secret": r"(?i)(token|secret|api[_-]?key|passwo?r?d|auth|bearer|credential|private[_-]?key)\W{0,4}$",
}
SHAPE = {
    "email": r"(?i)^[a-z0-9].*[a-z0-9]$", "ip": r":|^[0-9]{1,3}(\.[0-9]{1,3}){3}$", "card": r"^[0-9]{4}[\x20-]|^[0-9]+$", "phone": r"^(\+[0-9]{1,3}[\x20-]?\(?[0-9]|\([0-9]{3}\)\x20|[0-9]{3}-|00)",
    "secret": r"^([0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]{20,}=*|(sk|pk|ghp|gho|xox[abp]|AKIA|AIza)[-_A-Za-z0-9]{16,})$",
}
LABELERS = ("shape", "gazetteer", "context", "check", "neighbour")
FEATURES = ("long", "digits", "variety", "quoted")
BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
#: Matches put in order at once; longer lists go chunk by chunk, so the work grows far slower than their square.
STEP = 64
_EMPTY = "array<struct<start:int,end:int,value:string>>"


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost non-overlapping matches."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pairs = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"))
    # split gives one gap more than there are matches; the last gap has no match
    matched = F.filter(pairs, lambda x: x["m"].isNotNull())

    def reach(part):
        return F.aggregate(part, F.lit(0), lambda n, x: n + x["g"] + F.length(x["m"]))

    def place(part, at):
        def one(x, i):
            end = at + reach(F.slice(part, 1, i + 1))
            return F.struct((end - F.length(x["m"])).alias("start"), end.alias("end"), x["m"].alias("value"))

        return F.transform(part, one)

    def step(acc, k):
        part = F.slice(matched, k * STEP + 1, F.lit(STEP))
        return F.struct((acc["at"] + reach(part)).alias("at"), F.concat(acc["out"], place(part, acc["at"])).alias("out"))

    chunks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(matched) - 1) / STEP).cast("int")))
    many = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast(_EMPTY).alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(matched) <= STEP, place(matched, F.lit(0))).otherwise(many)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    n = F.length(digits(value))
    if kind == "card":
        return n.between(16, 19) & F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def base_matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, value, base>>: what the base pattern matches, and whether it passes the check; runs too short for any check go."""
    gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATES[kind])
    none = F.array().cast(_EMPTY)
    near = F.filter(F.when(gate, found(text, BASE[kind])).otherwise(none), lambda x: F.length(digits(x.value)) >= 13) if kind == "card" else F.when(gate, found(text, BASE[kind])).otherwise(none)
    return F.transform(near, lambda x: F.struct(x.start, x.end, x.value, passes(kind, x.value).alias("base")))


def wide_matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, value, base>>: what only the wide pattern matches; base is null."""
    got = F.when(text.rlike(WIDE_GATES[kind]), found(text, WIDE[kind])).otherwise(F.array().cast(_EMPTY))
    return F.transform(got, lambda x: F.struct(x.start, x.end, x.value, F.lit(None).cast("boolean").alias("base")))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def labelled(text: Column, kind: str, matches: Column, others: Column) -> Column:
    """array<struct<start, end, base, votes by LABELERS, FEATURES>> of matches; ``others``: whether the text has candidates of other kinds."""

    def label(x):
        before = F.substring(text, F.greatest(F.lit(1), x.start - 39), F.least(x.start, F.lit(40)))
        n, size = F.length(digits(x.value)), F.length(x.value)
        kinds_of = F.size(F.array_distinct(F.split(F.substring(x.value, 1, 64), "")))
        ok = {
            "email": x.value.rlike(r"[@\])]"), "ip": x.value.rlike(":") | passes("ip", x.value), "card": F.coalesce(F.call_function("luhn_check", digits(x.value)), F.lit(False)), "phone": n.between(9, 15),
            "secret": (kinds_of >= 10) & (n >= 4) & (n < size),
        }[kind]
        known = before.rlike(GAZETTEER[kind]) if kind == "secret" else x.value.rlike(GAZETTEER[kind])
        after = F.substring(text, x.end + 1, F.lit(1))
        quoted = (F.substring(before, -1, 1).isin('"', "'", "(", "<", "[")) | after.isin('"', "'", ")", ">", "]")
        return F.struct(
            x.start.alias("start"), x.end.alias("end"), x.base.alias("base"), vote(x.value.rlike(SHAPE[kind]), F.lit(False)).alias("shape"), vote(known, F.lit(kind != "secret")).alias("gazetteer"),
            vote(before.rlike(CONTEXT[kind]), F.lit(False)).alias("context"), vote(ok, F.lit(True)).alias("check"), vote(others, F.lit(False)).alias("neighbour"),
            F.least(F.lit(3), F.floor(size / 12)).cast("int").alias("long"), F.floor(F.lit(3) * n / F.greatest(size, F.lit(1))).cast("int").alias("digits"), F.least(F.lit(3), F.floor(kinds_of / 5)).cast("int").alias("variety"), quoted.cast("int").alias("quoted"),
        )

    return F.transform(matches, label)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def reliabilities(rows: list[tuple], rounds: int = 60) -> tuple[list[float], list[dict]]:
    """(posterior by row, log-likelihood ratio by labeler and vote) by EM over rows (votes, anchor, n).

    Labelers vote independently given the class; anchors (True or False) hold a row's class, None leaves it open.
    """
    total = sum(n for _, _, n in rows)
    hold = {True: 1.0 - 1e-6, False: 1e-6}
    post = [hold.get(a, _sigmoid(1.5 * sum(v))) for v, a, _ in rows]
    table: list[dict] = []
    for _ in range(rounds):
        prior = (sum(p * n for p, (_, _, n) in zip(post, rows, strict=True)) + 1) / (total + 2)
        table = []
        for i in range(len(LABELERS)):
            # pseudo-counts hold each labeler to being better than chance
            like = {(y, x): 1.0 + (2.0 if (x > 0) == (y == 1) and x else 0.0) for y in (0, 1) for x in (-1, 0, 1)}
            for p, (v, _, n) in zip(post, rows, strict=True):
                like[1, v[i]] += p * n
                like[0, v[i]] += (1 - p) * n
            norm = {y: sum(like[y, x] for x in (-1, 0, 1)) for y in (0, 1)}
            table.append({x: math.log(like[1, x] / norm[1]) - math.log(like[0, x] / norm[0]) for x in (-1, 0, 1)})
        odds = [math.log(prior / (1 - prior)) + sum(t[x] for t, x in zip(table, v, strict=True)) for v, _, _ in rows]
        post = [hold.get(a, _sigmoid(o)) for (_, a, _), o in zip(rows, odds, strict=True)]
    return post, table


def fit(patterns: list[tuple]) -> dict[str, tuple[float, list[float]]]:
    """{kind: (bias, weights)} of the span classifier from (kind, votes, features, anchor, n) counts.

    A logistic regression on votes and features, trained on the posteriors of ``reliabilities`` weighted by counts.
    """
    out = {}
    for kind in KINDS:
        rows = [(v, f, a, n) for k, v, f, a, n in patterns if k == kind]
        if not rows:
            continue
        total = sum(r[3] for r in rows)
        post, _ = reliabilities([(v, a, n) for v, _, a, n in rows])
        x = [[*v, *(g / 3 for g in f)] for v, f, _, _ in rows]
        start = [1.0] * len(LABELERS) + [0.0] * len(FEATURES)
        w, bias = list(start), -2.0
        for _ in range(800):
            gw, gb = [0.02 * (a - b) for a, b in zip(w, start, strict=True)], 0.02 * (bias + 2.0)
            for p, r, (_, _, _, n) in zip(post, x, rows, strict=True):
                err = (_sigmoid(bias + sum(a * b for a, b in zip(w, r, strict=True))) - p) * n / total
                gb += err
                gw = [g + err * b for g, b in zip(gw, r, strict=True)]
            w, bias = [a - 0.5 * g for a, g in zip(w, gw, strict=True)], bias - 0.5 * gb
        out[kind] = (bias, w)
    return out


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and c_<kind>: labelled candidates of each kind, from one pass over the texts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    matched = F.struct(*[(F.concat(base_matches(F.col("t"), k), wide_matches(F.col("t"), k)) if k in BASE else wide_matches(F.col("t"), k)).alias(k) for k in KINDS])
    # one value, so that no kind is matched again for the others' neighbour votes
    def label(m):
        many = {k: F.size(m[k]) > 0 for k in KINDS}

        def others(kind):
            out = F.lit(False)
            for k in KINDS:
                if k != kind:
                    out = out | many[k]
            return out

        return F.struct(*[labelled(F.col("t"), k, m[k], others(k)).alias(k) for k in KINDS])

    return got.select("doc_id", F.transform(F.array(matched), label)[0].alias("c")).select("doc_id", *[F.col(f"c.{k}").alias(f"c_{k}") for k in KINDS])


def vote_counts(found_: DataFrame) -> list[tuple]:
    """(kind, votes, features, anchor, n) over all candidates; at most 5 kinds times 3**5 votes, 4 * 4 * 4 * 2 features and 3 anchors."""
    rows = []
    cols = ["base", *LABELERS, *FEATURES]
    some = None
    for k in KINDS:
        one = found_.where(F.size(f"c_{k}") > 0).select(F.lit(k).alias("kind"), F.explode(f"c_{k}").alias("c"))
        one = one.select("kind", *[F.col(f"c.{x}").alias(x) for x in cols])
        some = one if some is None else some.unionByName(one)
    for r in some.groupBy("kind", *cols).agg(F.count("*").alias("n")).collect():  # bounded, see above
        rows.append((r.kind, tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r.base, r.n))
    return sorted(rows, key=str)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", certain: float = 0.8) -> DataFrame:
    """doc_id, base and added (arrays of struct<kind, start, end>) for each row of docs."""
    s = Scratch(docs.sparkSession, "pii")
    got = s.save(candidates(docs, id_col, text_col), "candidates")
    model = fit(vote_counts(got))

    def clear(of, x):
        return ~F.exists(of, lambda y: (x.start < y.end) & (y.start < x.end))

    def named(spans, kind):
        return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("kind"), x.start.alias("start"), x.end.alias("end")))

    def accepted(kind):
        bias, w = model[kind]

        def good(c):
            odds = F.lit(bias)
            for a, x in zip(w, LABELERS, strict=False):
                odds = odds + F.lit(a) * c[x]
            for a, x in zip(w[len(LABELERS) :], FEATURES, strict=True):
                odds = odds + F.lit(a / 3) * c[x]
            return c.base.isNull() & (odds >= math.log(certain / (1 - certain))) & clear(F.col("base"), c) & clear(F.col("added"), c)

        return F.filter(f"c_{kind}", good)

    base = F.concat(*[named(F.filter(f"c_{k}", lambda x: F.coalesce(x.base, F.lit(False))), k) for k in BASE_KINDS])
    out = got.withColumn("base", base).withColumn("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    for k in KINDS:
        if k in model:
            out = out.withColumn("added", F.when(F.size(f"c_{k}") == 0, F.col("added")).otherwise(F.concat("added", named(accepted(k), k))))
    return out.select("doc_id", "base", "added")


def joined(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    order = F.transform(spans, lambda x: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), x.kind).alias("o"), x.start.alias("start"), x.end.alias("end"), x.kind.alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
