"""Personal data: generators propose spans, boosted trees with calibrated thresholds select among them.

Everything over texts is a column expression. Strict generators give the base spans, which always stay; loose ones
propose spans that may overlap them and each other: addresses spelt out or with spaces, defanged and version 6
addresses, card numbers in other groups, phone numbers without a country code, credentials (a kind of their own). Each
candidate has small integer features of its format and of the characters around it. It is labelled by evidence that
isn't a feature: good are values inside a base span of their kind, base addresses spelt out, those that a check of
their own confirms (Luhn, ranges of parts), and those after a word such as "call" or "token"; bad are those after a
word such as "order", with letters or digits at their edge, or that fail the check. A candidate without evidence isn't
labelled and counts for neither side.

Spark counts the labelled ones with each combination of features; the number of combinations is bounded by the product
of the features' ranges. For each kind depth-2 trees are boosted on that table; a fold of documents held out sets the
threshold at which PRECISION is reached, and the trees become a column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: What a base span is. The run before an @ and the digits of an address start where such a run starts
#: or the last match ends, and are possessive: no match is lost, and a text is scanned once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NAME = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
_AT, _DOT = r"(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| at | @ ?|@ )", r"(?:\.| ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot )"
_OCTET = r"(?:[0-9]{1,3})"
LOOSE = {
    "email": rf"{_NAME}{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{{1,4}}:){{2,7}}(?::?[0-9A-Fa-f]{{1,4}}){{1,7}}|{_OCTET}(?:(?:\[\.\]|\(\.\)| \. |\[dot\]){_OCTET}){{3}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){3}|[0-9]{13,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9])(?:\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}|00[1-9][ .-]?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){2,4}|0[1-9][0-9]{1,3}[ /-][0-9]{3,4}[ -]?[0-9]{3,4})(?![0-9])",
    "secret": r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}",
}
ALL_KINDS = (*KINDS, *(k for k in LOOSE if k not in KINDS))  #: in the order of results
NEEDS = {"email": r"@|\b(?:at|AT)\b", "ip": r"[0-9A-Fa-f][.:\])]", "card": "[0-9]{4}", "phone": "[0-9]{3}", "secret": "[A-Za-z0-9+/_-]{20}"}
GUARD = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
#: Words before a loose candidate that speak for and against it.
FOR = {
    "email": r"(?i)(?<![a-z])(e-?mail|contact|write|reach|address)( (to|at|me|us))*[^A-Za-z]*$",
    "ip": r"(?i)(?<![a-z])(ip|ipv6|host|server|address|addr)[^A-Za-z]*$",
    "card": r"(?i)(?<![a-z])(card|visa|mastercard|amex|credit|debit)( (no|nr|number))*[^A-Za-z]*$",
    "phone": r"(?i)(?<![a-z])((tele)?phone|tel|call|fax|mobile|cell|contact|dial|reach)( (me|us|at|on))*[^A-Za-z]*$",
    "secret": r"(?i)(token|secret|passw(or)?d|pwd|api[_ -]?key|access[_ -]?key|credentials?|bearer)[^A-Za-z0-9]*$",
}
AGAINST = r"(?i)(?<![a-z])(order|invoice|isbn|issn|serial|part|item|ref|case|ticket|account|batch|lot|model|version|id|look(s|ed|ing)?|commit|sha|sha1|sha256|md5|digest|checksum|hash|uuid|href|src|time|date)( (no|nr|number|id))*[^A-Za-z]*$"
FEATURES = {"length": 8, "digits": 5, "signs": 4, "lead": 4, "tail": 3, "format": 3}  #: and how many values each has
ROUNDS, RATE, PRECISION, FOLDS = 24, 0.3, 0.9, 5  #: of ten labelled candidates selected, nine at least are good
SPELT = len(BASE) + len(LOOSE)  #: source of base addresses spelt out, for training alone
BLOCK = 64  #: spans that are added up or searched together: a text of many costs little more a span than one of few


def let(x: Column, f) -> Column:
    """f(x), with x evaluated once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns, each evaluated once a row: the generator keeps the optimiser from repeating them."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns], F.inline_outer(F.array(F.struct(*[x.alias(n) for n, x in columns.items()]))))


def _matches(text: Column, pattern: str, guard: str) -> Column:
    return F.when(text.rlike(guard), F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between")))


def _blocks(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(BLOCK)), lambda i: F.slice(x, i + 1, F.lit(BLOCK)))


def _located(raw: Column) -> Column:
    """array<struct<start, end, match, before, after>>, code points, end exclusive."""
    found, between = raw["found"], raw["between"]
    n = F.size(found)
    steps = F.zip_with(F.slice(between, F.lit(1), n), found, lambda b, m: F.struct(F.char_length(b).alias("gap"), F.char_length(m).alias("size"), m.alias("match"), F.right(b, F.lit(24)).alias("before")))
    steps = F.zip_with(steps, F.slice(between, F.lit(2), n), lambda s, b: s.withField("after", F.left(b, F.lit(1))))
    kind = "array<struct<start:int,end:int,match:string,before:string,after:string>>"

    def step(acc: Column, s: Column) -> Column:
        at = acc["at"] + s["gap"]
        return F.struct((at + s["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(at.alias("start"), (at + s["size"]).alias("end"), s["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after")))).alias("out"))

    def placed(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, s: a + s["gap"] + s["size"]))
        heads = F.aggregate(sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
        return F.flatten(F.zip_with(blocks, heads, lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), step, lambda a: a["out"])))

    return F.coalesce(F.when(n > 0, let(let(steps, _blocks), placed)), F.array().cast(kind))


def luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _strict(kind: str):
    """kind, start, end of the spans that pass the kind's test."""
    return lambda spans: F.transform(F.filter(spans, lambda s: _valid(kind, s["match"])), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _evidence(kind: str, s: Column) -> Column:
    """1, -1 or 0 by what isn't a feature: the words before, the edges, a check of the value."""
    m, before = s["match"], s["before"]
    edge = before.rlike(r"[0-9A-Za-z.]$") | s["after"].rlike("^[0-9A-Za-z]")
    against, good = before.rlike(AGAINST) | edge, before.rlike(FOR[kind])
    if kind == "email":
        against = against | ~m.rlike(r"[A-Za-z]{2,}$")
    if kind == "ip":  # eight groups or an omission, and a letter; or four parts in range
        dotted = ~m.contains(":") & F.forall(F.filter(F.split(m, "[^0-9]+"), lambda x: x != ""), lambda x: x.cast("int") <= 255)
        six = m.rlike("[A-Fa-f]") & (m.contains("::") | (F.size(F.split(m, ":")) == 8))
        good, against = good | dotted | six, against | ~(dotted | m.contains(":")) | m.rlike("^[0-9]{1,2}(:[0-9]{2})+$")
    if kind == "card":
        good, against = good & luhn(_digits(m)), against | ~luhn(_digits(m))
    return F.when(against, -1).when(good, 1).otherwise(0)


def _loose(kind: str, spelt: bool = False):
    """kind, start, end, label and the features of a loose candidate."""

    def make(s: Column) -> Column:
        m = s["match"]
        form = {"email": r"[A-Za-z]{2,}$", "ip": "[A-Fa-f]|::", "card": "^[3-6]", "phone": "[2-9][0-9]{2}[ ).-]+[2-9][0-9]{2}[ .-][0-9]{4}$", "secret": "^[0-9a-f]+$|^[0-9A-F]+$"}[kind]
        return F.struct(
            F.lit(kind).alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            (F.lit(1) if spelt else _evidence(kind, s)).alias("label"),
            F.least(F.floor((s["end"] - s["start"]) / 6), F.lit(7)).cast("int").alias("length"),
            let(F.length(_digits(m)), lambda n: F.when(n == 0, 0).when(n < 9, 1).when(n < 13, 2).when(n < 20, 3).otherwise(4)).alias("digits"),
            F.when(m.rlike(r"[\[\](){}<>]"), 3).when(m.rlike("[._/:]"), 2).when(m.rlike("[ -]"), 1).otherwise(0).alias("signs"),
            F.when(s["before"].rlike("[\"'`]$"), 3).when(s["before"].rlike("[:=(\\[{<]\\s?$"), 2).when(s["before"].rlike("(^|\\s)$"), 1).otherwise(0).alias("lead"),
            F.when(s["after"].rlike("[\"'`)\\]}>]"), 2).when(s["after"].rlike("^$|\\s|[.,;!?]"), 1).otherwise(0).alias("tail"),
            (m.rlike(form).cast("int") + m.rlike("[a-z]").cast("int")).alias("format"),
        )

    return make


def _spelt(s: Column) -> Column:
    """A base address as it would stand spelt out."""
    local, domain = F.split_part(s["match"], F.lit("@"), F.lit(1)), F.split_part(s["match"], F.lit("@"), F.lit(2))
    m = F.concat(local, F.lit(" [at] "), F.replace(domain, F.lit("."), F.lit(" [dot] ")))
    return F.struct(s["start"].alias("start"), (s["start"] + F.char_length(m)).alias("end"), m.alias("match"), s["before"].alias("before"), s["after"].alias("after"))


def candidates(documents: DataFrame, spelt: bool = False) -> DataFrame:
    """documents with __base and __loose: arrays of structs of kind, start and end, those in __loose also with label and
    features; null text is empty. spelt adds the base addresses spelt out."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    raw = {f"__b_{k}": _matches(text, p, GUARD[k]) for k, p in BASE.items()} | {f"__l_{k}": _matches(text, p, NEEDS[k]) for k, p in LOOSE.items()}
    found = once(once(documents, **raw), **{f"{n}_at": _located(F.col(n)) for n in raw})
    loose = [F.transform(F.col(f"__l_{k}_at"), _loose(k)) for k in LOOSE]
    if spelt:
        loose.append(F.transform(F.transform(F.col("__b_email_at"), _spelt), _loose("email", True)))
    made = once(found, __base=F.concat(*[_strict(k)(F.col(f"__b_{k}_at")) for k in BASE]), __loose=F.concat(*loose))
    return made.select(*[F.col(f"`{c}`") for c in documents.columns], "__base", "__loose")


def _ordered(base: Column) -> Column:
    """Blocks of spans in order, each with its least start and greatest end."""
    blocks = F.when(F.size(base) > 0, let(F.array_sort(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind")))), _blocks))
    return F.coalesce(F.transform(blocks, lambda b: F.struct(b[0]["start"].alias("start"), F.array_max(F.transform(b, lambda s: s["end"])).alias("end"), b.alias("spans"))), F.array().cast("array<struct<start:int,end:int,spans:array<struct<start:int,end:int,kind:string>>>>"))


def _covered(ordered: Column, c: Column, kind: bool) -> Column:
    """Whether c overlaps one of the spans (of its kind)."""
    meets = lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])
    return F.exists(ordered, lambda b: meets(b) & F.exists(b["spans"], lambda s: meets(s) & (s["kind"] == c["kind"] if kind else F.lit(True))))


def _table(found: DataFrame) -> dict[str, list[tuple]]:
    """By kind, rows (held out, features..., labelled candidates, of them good): at most 2 * product of FEATURES a kind."""
    found = once(found.select("doc_id", "__base", "__loose"), __spans=_ordered(F.col("__base")))

    def row(c: Column) -> Column:
        inside = _covered(F.col("__spans"), c, True)
        label = F.when(inside, F.when(c["kind"].isin("phone"), 1).when(c["label"] == 1, 1).otherwise(0)).otherwise(c["label"])
        return F.struct(c["kind"].alias("kind"), *[c[f].alias(f) for f in FEATURES], label.alias("label"))

    fold = F.abs(F.xxhash64("doc_id")) % FOLDS == 0
    rows = found.select(fold.alias("held"), F.explode(F.transform("__loose", row)).alias("c")).where("c.label <> 0")
    counts = rows.groupBy("c.kind", "held", *[F.col(f"c.{f}").alias(f) for f in FEATURES]).agg(F.count("*").alias("n"), F.count_if(F.col("c.label") > 0).alias("good")).collect()
    return {kind: sorted(tuple(r)[1:] for r in counts if r[0] == kind) for kind in LOOSE}


class Trees:
    """Depth-2 regression trees boosted for the logistic loss on counts by feature combination."""

    def __init__(self, rows: list[tuple]):
        fit, held = ([r[1:] for r in rows if bool(r[0]) is h] for h in (False, True))
        n, good = sum(r[-2] for r in fit), sum(r[-1] for r in fit)
        self.start = math.log((good + 1) / (n - good + 1))
        self.trees: list[tuple] = []
        scores = [self.start] * len(fit)
        for _ in range(ROUNDS if 0 < good < n else 0):
            p = [1 / (1 + math.exp(-s)) for s in scores]
            grad = [r[-1] - r[-2] * q for r, q in zip(fit, p, strict=True)]
            weight = [r[-2] * q * (1 - q) for r, q in zip(fit, p, strict=True)]
            tree = self._grow(fit, grad, weight, list(range(len(fit))), 2)
            self.trees.append(tree)
            scores = [s + self._leaf(tree, r) for s, r in zip(scores, fit, strict=True)]
        self.threshold = self._calibrate(held or fit)

    @staticmethod
    def _grow(rows, grad, weight, at, depth) -> tuple:
        g, w = sum(grad[i] for i in at), sum(weight[i] for i in at)
        best = (1e-9, None)
        for f, size in enumerate(FEATURES.values()) if depth else ():
            for cut in range(size - 1):
                a, b = [i for i in at if rows[i][f] <= cut], [i for i in at if rows[i][f] > cut]
                if a and b:
                    gain = sum(sum(grad[i] for i in x) ** 2 / (sum(weight[i] for i in x) + 1) for x in (a, b)) - g * g / (w + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, cut, a, b))
        if best[1] is None:
            return (RATE * g / (w + 1),)
        f, cut, a, b = best[1]
        return f, cut, Trees._grow(rows, grad, weight, a, depth - 1), Trees._grow(rows, grad, weight, b, depth - 1)

    @staticmethod
    def _leaf(tree: tuple, row: tuple) -> float:
        while len(tree) > 1:
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree[0]

    def score(self, row: tuple) -> float:
        return self.start + sum(self._leaf(t, row) for t in self.trees)

    def _calibrate(self, rows: list[tuple]) -> float:
        """The least score from which on PRECISION of the held-out candidates are good; never below even odds."""
        threshold, n, good = math.inf, 0, 0
        ranked = sorted(((self.score(r), r[-2], r[-1]) for r in rows), reverse=True)
        for k, (s, count, hits) in enumerate(ranked):
            n, good = n + count, good + hits
            if (k + 1 == len(ranked) or ranked[k + 1][0] < s) and good >= PRECISION * n and s >= 0:
                threshold = s
        return threshold

    def column(self, c: Column) -> Column:
        names = list(FEATURES)

        def node(tree: tuple) -> Column:
            return F.lit(tree[0]) if len(tree) == 1 else F.when(c[names[tree[0]]] <= tree[1], node(tree[2])).otherwise(node(tree[3]))

        total = F.lit(self.start)
        for tree in self.trees:
            total = total + node(tree)
        return total


def train(documents: DataFrame) -> dict[str, Trees]:
    """The trees of each loose generator, by kind."""
    return {kind: Trees(rows) for kind, rows in _table(candidates(documents.select(F.col("doc_id"), F.col("text")), spelt=True)).items()}


def find(documents: DataFrame, trees: dict[str, Trees] | None = None) -> DataFrame:
    """documents, every column, with pii (in place of one of that name): array of struct(kind, start, end, base), by kind as in
    ALL_KINDS, then start.

    Positions are code points of the whole text, the end exclusive. Base spans always stay; a loose candidate is
    added if its score reaches its kind's threshold and it overlaps no base span. Null and empty texts have none;
    repeated rows each give one; an empty table gives no rows.
    """
    trees = trees or train(documents)
    able = {kind: t for kind, t in trees.items() if math.isfinite(t.threshold)}
    kept = [F.col(f"`{c}`") for c in documents.columns if c.lower() != "pii"]
    found = candidates(documents.drop("pii"))
    rank = F.create_map(*[x for i, k in enumerate(ALL_KINDS) for x in (F.lit(k), F.lit(i))])

    def chosen(c: Column) -> Column:
        out = F.lit(False)
        for kind, t in able.items():
            out = F.when(c["kind"] == kind, t.column(c) >= t.threshold - 1e-9).otherwise(out)  # the column adds up in another order
        return out

    slim = lambda a, base: F.transform(a, lambda c: F.struct(rank[c["kind"]].alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.lit(base).alias("base")))
    picked = once(found, __picked=F.filter("__loose", chosen) if able else F.slice("__loose", 1, 0))
    picked = once(picked, __spans=F.when(F.size("__picked") > 0, _ordered(F.col("__base"))))
    extra = F.when(F.col("__spans").isNotNull(), F.filter("__picked", lambda c: ~_covered(F.col("__spans"), c, False))).otherwise(F.col("__picked"))
    return once(picked, pii=F.array_sort(F.concat(slim(F.col("__base"), True), slim(extra, False)))).select(*kept, "pii")


def redact(documents: DataFrame, trees: dict[str, Trees] | None = None) -> DataFrame:
    """documents with the text's personal data replaced by [KIND]; overlapping spans count as the first of them. Rows and
    other columns stay as they are, a null text too."""
    own = {c: f"__own_{i}" for i, c in enumerate(documents.columns) if c.lower() == "pii"}  # a column of the input's
    columns = documents.columns
    found = find(documents.withColumnsRenamed(own), trees)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], -s["less"]).alias("at"), F.when(new, F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    clean = F.when(F.size("pii") > 0, clean).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in columns])


def op3_pii(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in KINDS]
    return found.select(F.col("doc_id").cast("long"), *counts, F.sha2(say(F.filter("pii", lambda s: s["base"])), 256).alias("base_sha256"), say(F.col("pii")).alias("spans"))
