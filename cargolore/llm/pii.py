"""Personal data by gradient-boosted scoring of proposed spans, in SQL functions.

Base kinds (``email, ip, card, phone``) are found by fixed patterns, leftmost
and without overlap, and are always redacted.  Beyond them, generators with high
recall propose spans that may overlap: addresses spelt out, numbers without a
country code, identity and bank numbers, and secrets such as keys and tokens.
Boosted trees score each proposal by its format (lengths, classes of characters,
runs, variety) and its context (words before it, quotes and signs around it);
per kind, the threshold lies half-way below the lowest score that reaches
``PRECISION`` on held-out rows.  Of proposals that overlap, the one with the best score above its
threshold stays, and none that overlaps a base span.

No table labels personal data, so the trees are fitted on ``TRAIN_ROWS`` rows
that ``training_rows`` makes up by rule: true and false proposals of each
generator with fitting and misleading contexts.  The fitted trees become one SQL
expression, so scoring is a narrow projection over the documents: no shuffle, no
Python.

The patterns are written so that each text is read in linear time: a repeated
group is possessive, and a match may only start where a run of its characters
starts (or where the match before has ended).  Positions are running sums, made in
two levels, and spans are searched by parts, so a text with very many spans, such
as a dump of addresses in one row, takes time as the 1.5th power of their number
at most.

Defined cases: a null or empty text has no spans; rows with null or repeated ids
are scored each on its own; of proposals that overlap with equal scores the one
that starts first stays, of those the shorter; a text of any length is read whole;
an empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are not
read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolore.llm.common import bound

TRAIN_ROWS = 4_000
PRECISION = 0.98
#: Code points of context before and after a proposal.
BEFORE, AFTER = 28, 4

# The base patterns; what they match is stated with each.
BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # four runs of digits between dots
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # maximal chains of digits with single spaces or hyphens between, of 13 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

PROPOSED = {
    "email_spelt": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}| at |@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{1,63}+){1,5}+",
    "phone_local": (
        r"(?<![0-9A-Za-z+.(])\(?[0-9](?:[\x20().-]{0,2}+[0-9]){6,14}+(?![0-9A-Za-z])",
        # groups of 3, 3 and 4 digits; an area code with 0 and one or two groups
        r"(?<![0-9A-Za-z+.(])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
        r"(?<![0-9A-Za-z+.(])\(?0[0-9]{1,4}\)?[\x20/-][0-9]{3,4}(?:[\x20-]?[0-9]{3,5})?(?![0-9])",
    ),
    "secret": r"(?<![A-Za-z0-9_/+=-])(?=[A-Za-z_/+=-]{0,64}+[0-9])[A-Za-z0-9_/+=-]{16,}+",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "bank": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
}
KINDS = tuple(PROPOSED)
#: A telephone number written in full and nothing more.
SHAPE = r"^(?:\([0-9]{3}\)|[0-9]{3})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}$|^\(?0[0-9]{1,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}$"

# Words that speak for a kind of personal data near by.
CONTEXT = {
    "says_phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|tél)\b",
    "says_mail": r"(?i)\b(?:e-?mail|contact|write|reach|kontakt|correo)\b",
    "says_secret": r"(?i)(?:token|key|secret|passw|pwd|api|auth|bearer|credential)",
    "says_bank": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "says_identity": r"(?i)\b(?:ssn|social|security|identity|passport|tax)\b",
}
FEATURES = (
    *(f"is_{k}" for k in KINDS), "length", "digits", "upper", "lower", "signs", "variety", "digit_runs", "case_turns",
    *CONTEXT, "bracketed", "spelt_dot", "quoted", "hex", "digit_first", "sentence", "shaped",
)

_SPAN = "array<struct<kind:string,s:int,e:int,m:string,before:string,after:string>>"


def _running(values: Column, op) -> Column:  # noqa: ANN001
    """For each of some whole numbers the sum or maximum (``op``) of those before it,
    0 at first, and last that of all.

    Folds copy what they have gathered at every step, so the numbers are cut in parts
    of about the root of their number: folds run over parts, and over their results.
    """

    def scan(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(op(F.element_at(a, -1), x))))

    def joined(parts: Column) -> Column:
        def moved(starts: Column) -> Column:
            each = F.zip_with(parts, F.slice(starts, 1, F.size(parts)), lambda w, o: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x: op(x, o)))
            return F.concat(F.flatten(each), F.array(F.element_at(starts, -1)))

        return bound(scan(F.transform(parts, lambda w: F.element_at(w, -1))), moved)

    def body(v: Column) -> Column:
        n = F.size(v)
        k = F.greatest(F.lit(16), F.ceil(F.sqrt(n)).cast("int"))
        parts = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / k).cast("int")), lambda i: scan(F.slice(v, i * k + 1, k)))
        return F.when(n > 0, bound(parts, joined)).otherwise(F.array(F.lit(0)))

    return bound(values, body)


def _in_parts(found: Column) -> Column:
    """Spans in parts of about the root of their number, each with its bounds."""
    n = F.size(found)
    width = F.greatest(F.lit(64), F.ceil(F.sqrt(n)).cast("int"))

    def part(i: Column) -> Column:
        own = F.transform(F.slice(found, i * width + 1, width), lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e")))
        return F.struct(F.array_min(F.transform(own, lambda b: b["s"])).alias("s"), F.array_max(F.transform(own, lambda b: b["e"])).alias("e"), own.alias("own"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), part))


def _meets(parts: Column, x: Column) -> Column:
    """Whether a span overlaps one of those ``_in_parts``."""

    def over(b: Column) -> Column:
        return (b["s"] < x["e"]) & (x["s"] < b["e"])

    return F.coalesce(F.exists(parts, lambda p: over(p) & F.exists(p["own"], over)), F.lit(False))


def spans(text: Column, kind: str, pattern: str) -> Column:
    """Every match as a struct: kind, start and end in code points, the match and
    what stands around it.  The pieces between matches give the positions."""
    none = F.array().cast(_SPAN)

    def body(v: Column) -> Column:
        pieces, matches = F.slice(v["pieces"], 1, F.size(v["matches"])), v["matches"]
        begins = _running(F.zip_with(pieces, matches, lambda p, m: F.length(p) + F.length(m)), lambda a, b: a + b)
        both = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m"), F.substring(p, -BEFORE, BEFORE).alias("before")))
        rest = F.transform(F.slice(v["pieces"], 2, F.greatest(F.size(matches), F.lit(1))), lambda p: F.substring(p, 1, AFTER))
        both = F.zip_with(both, rest, lambda x, a: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), x["before"].alias("before"), a.alias("after")))

        def placed(x: Column, at: Column) -> Column:
            first = at + x["gap"]
            return F.struct(F.lit(kind).alias("kind"), first.alias("s"), (first + F.length(x["m"])).alias("e"), x["m"].alias("m"), x["before"].alias("before"), x["after"].alias("after"))

        return F.when(F.size(matches) > 0, F.zip_with(both, F.slice(begins, 1, F.size(matches)), placed)).otherwise(none)

    return bound(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("matches")), body)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """For each base kind the spans that pass its check."""
    small = r"^0*+(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
    checks = {
        "email": None,
        "ip": lambda x: F.forall(F.split(x["m"], r"\."), lambda p: p.rlike(small)),
        "card": lambda x: luhn(_digits(x["m"])),
        "phone": lambda x: F.length(_digits(x["m"])).between(9, 15),
    }
    out = {}
    for kind, pattern in BASE.items():
        found = spans(text, kind, pattern)
        if checks[kind]:
            found = F.filter(found, checks[kind])
        if NEEDS[kind]:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(_SPAN))
        out[kind] = found
    return out


def features(x: Column) -> list[Column]:
    """The values of ``FEATURES`` for a proposal (a struct as ``spans`` gives)."""
    m, size = x["m"], F.length(x["m"])

    def left(pattern: str) -> Column:
        return size - F.length(F.regexp_replace(m, pattern, ""))

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    return [
        *(flag(x["kind"] == k) for k in KINDS),
        size.cast("double"), left("[0-9]").cast("double"), left("[A-Z]").cast("double"), left("[a-z]").cast("double"), left("[^A-Za-z0-9]").cast("double"),
        F.size(F.array_distinct(F.split(m, ""))) / size,
        F.size(F.split(m, "[0-9]+")).cast("double"), F.size(F.split(m, "(?<=[a-z])(?=[A-Z0-9])|(?<=[0-9])(?=[A-Za-z])")).cast("double"),
        *(flag(x["before"].rlike(p)) for p in CONTEXT.values()),
        flag(m.rlike(r"(?i)[(\[{](?:at|dot)[)\]}]")), flag(m.rlike("(?i) dot ")),
        flag(x["before"].rlike(r"[=:\"'`]\s?$") | x["after"].rlike("^[\"'`]")), flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        flag(m.rlike("^[(]?[0-9]")), flag(m.rlike(r"\. ")), flag(m.rlike(SHAPE)),
    ]


def training_rows(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """``label, part, x`` (a proposal as ``spans`` gives) of made-up proposals."""

    def pick(salt: str, *values: str) -> Column:
        return F.array(*(F.lit(v) for v in values))[F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(values))).cast("int")]

    def code(salt: str, n: int) -> Column:
        return F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256), 1, n)

    def digits(salt: str, n: int) -> Column:
        return F.translate(code(salt, n), "abcdef", "174093")

    def shout(salt: str, n: int) -> Column:
        return F.translate(code(salt, n), "0123456789abcdef", "QW7RTY3PLK5MNB2X")

    def mixed(salt: str, n: int) -> Column:
        return F.substring(F.translate(F.base64(F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256).cast("binary")), "=", ""), 1, n)

    word = lambda s: pick(s, "the", "report", "harbor", "signal", "meeting", "garden", "letter", "winter", "table", "number")
    name = F.concat(pick("n1", "anna", "j.smith", "maria_k", "info", "tom", "li.wei"), pick("n2", "", "7", "42", ".x"))
    any_of = lambda salt, *cols: F.array(*cols)[F.pmod(F.xxhash64(F.col("id"), F.lit(salt)), F.lit(len(cols))).cast("int")]
    true = {
        "email_spelt": F.concat(name, pick("at", " at ", " [at] ", "(at)", " (at) ", "[at]"), pick("d", "example", "mail", "host-7", "web"), pick("dot", " dot ", "[dot]", " [dot] ", "(dot)"), pick("tld", "com", "org", "net", "de")),
        "phone_local": any_of("p", F.concat(F.lit("("), digits("a", 3), F.lit(") "), digits("b", 3), F.lit("-"), digits("c", 4)), F.concat_ws("-", digits("a", 3), digits("b", 3), digits("c", 4)), F.concat_ws(".", digits("a", 3), digits("b", 3), digits("c", 4)), F.concat(F.lit("0"), digits("a", 2), F.lit(" "), digits("b", 4), F.lit(" "), digits("c", 4)), F.concat(F.lit("0"), digits("a", 3), pick("z", "/", "-", " "), digits("b", 4), digits("c", 3))),
        "secret": any_of("s", F.concat(F.lit("AKIA"), shout("a", 16)), code("a", 40), code("b", 32), F.concat(F.lit("sk_live_"), mixed("a", 24)), F.concat(F.lit("ghp_"), mixed("b", 36)), mixed("c", 40), F.upper(code("d", 40))),
        "identity": F.concat_ws("-", digits("a", 3), digits("b", 2), digits("c", 4)),
        "bank": any_of("b", F.concat(F.lit("DE"), digits("a", 20)), F.concat_ws(" ", F.concat(F.lit("GB"), digits("a", 2)), F.lit("WEST"), digits("b", 4), digits("c", 4), digits("d", 4), digits("e", 2)), F.concat(F.lit("FR"), digits("b", 25))),
    }
    false = {
        "email_spelt": any_of("e", F.concat(word("a"), F.lit(" at "), word("b"), F.lit(". "), F.initcap(word("c"))), F.concat(word("a"), F.lit(" at "), digits("b", 1), F.lit("."), digits("c", 2)), F.concat(word("a"), F.lit(" at "), word("b"), F.lit(". "), word("c"), F.lit(". "), word("d"))),
        "phone_local": any_of("p", F.concat(F.lit("20"), digits("a", 2), F.lit("-01-"), digits("b", 2)), digits("a", 8), digits("b", 10), F.concat(digits("a", 1), F.lit("."), digits("b", 9)), F.concat_ws(".", digits("a", 2), F.lit("000"), F.lit("000")), F.concat_ws(" ", digits("a", 1), digits("b", 1), digits("c", 1), digits("d", 1), digits("e", 1), digits("f", 1), digits("g", 1)), digits("h", 15),
            # a number with the rest of another one, or with a figure after it
            F.concat(digits("a", 4), F.lit(" "), F.concat_ws("-", digits("b", 3), digits("c", 3), digits("d", 4))), F.concat(F.concat_ws("-", digits("b", 3), digits("c", 3), digits("d", 4)), F.lit(" "), digits("e", 2)),
            F.concat(F.concat_ws("-", digits("b", 3), digits("c", 3), digits("d", 4)), F.lit(" "), digits("a", 3), F.lit("-"), digits("e", 2))),
        "secret": any_of("s", F.concat_ws("-", word("a"), digits("b", 2), word("c"), word("d")), F.concat_ws("/", word("a"), F.lit("20"), digits("b", 2), word("c"), word("d")), F.concat(F.repeat(word("a"), 4), digits("b", 1)), digits("c", 18), digits("g", 20), digits("h", 26), F.concat(F.repeat(F.lit("="), 18), digits("d", 1)), F.concat_ws("_", word("a"), word("b"), word("c"), digits("e", 1)), F.concat(F.repeat(F.lit("-"), 20), digits("f", 2))),
        "identity": F.concat_ws("-", digits("a", 3), digits("b", 2), digits("c", 4)),
        "bank": F.concat(F.lit("AB"), digits("a", 2), F.lit(" "), shout("b", 4), F.lit(" "), shout("c", 4)),
    }
    fits = {
        "email_spelt": pick("ctx", "contact ", "e-mail: ", "write to ", "", "the of ", "reach me: "),
        "phone_local": pick("ctx", "call ", "phone: ", "tel. ", "mobile ", "", "ring thest "),
        "secret": pick("ctx", 'token = "', "api key: ", "secret=", "", "onhe are ", "password: ", "Bearer "),
        "identity": pick("ctx", "ssn ", "social security ", "tax id: ", "identity no. "),
        "bank": pick("ctx", "iban ", "account: ", "bank ", ""),
    }
    base = spark.range(rows, numPartitions=1)
    kind = F.array(*(F.lit(k) for k in KINDS))[(F.col("id") % len(KINDS)).cast("int")]
    base = base.withColumns({"kind": kind, "label": (F.floor(F.col("id") / len(KINDS)) % 2).cast("double"), "part": F.pmod(F.xxhash64("id", F.lit("part")), F.lit(3)).cast("int")})

    def by_kind(of: dict[str, Column]) -> Column:
        return reduce(lambda a, k: F.when(F.col("kind") == k, of[k]).otherwise(a), KINDS, F.lit(""))

    away = pick("away", "in the ", "version ", "page ", "item no. ", "and of ", "total: ", "")
    m = F.when(F.col("label") == 1, by_kind(true)).otherwise(by_kind(false))
    before = F.when(F.col("label") == 1, by_kind(fits)).otherwise(away)
    x = F.struct("kind", F.lit(0).alias("s"), F.length(m).alias("e"), m.alias("m"), before.alias("before"), pick("after", " ", ".", '"', " th").alias("after"))
    return base.select("label", "part", x.alias("x"))


def _tree_sql(node, names: list[str]) -> str:  # noqa: ANN001
    """A fitted tree as a SQL expression over feature names."""
    if node.subtreeDepth() == 0:
        return f"{node.prediction()!r}D"
    split = node.split()
    name = names[split.featureIndex()]
    return f"IF({name} <= {split.threshold()!r}D, {_tree_sql(node.leftChild(), names)}, {_tree_sql(node.rightChild(), names)})"


class SpanModel:
    """Boosted trees as SQL over a struct ``f`` of features, and thresholds by kind."""

    def __init__(self, sql: str, thresholds: dict[str, float]) -> None:
        self.sql, self.thresholds = sql, thresholds


def fit(spark: SparkSession, rows: int = TRAIN_ROWS, precision: float = PRECISION) -> SpanModel:
    """Fit on two thirds of the made-up rows, set thresholds on the rest."""
    table = training_rows(spark, rows).select("label", "part", "x.kind", *(c.alias(n) for c, n in zip(features(F.col("x")), FEATURES, strict=True)))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table).persist()
    model = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.3, seed=1).fit(table.where("part < 2").select("label", "features"))
    names = [f"f.{n}" for n in FEATURES]
    trees, weights = model._java_obj.trees(), model.treeWeights
    sql = " + ".join(f"{w!r}D * {_tree_sql(trees[i].rootNode(), names)}" for i, w in enumerate(weights))
    sql = f"1.0D / (1.0D + exp(-2.0D * ({sql})))"
    held = table.where("part = 2").select("kind", "label", F.struct(*FEATURES).alias("f")).selectExpr("kind", "label", f"round({sql}, 4) AS score")
    right = "sum(label) OVER (PARTITION BY kind ORDER BY score DESC RANGE UNBOUNDED PRECEDING)"
    every = "count(*) OVER (PARTITION BY kind ORDER BY score DESC RANGE UNBOUNDED PRECEDING)"
    ranked = held.selectExpr("kind", "score", f"{right} / {every} AS p").distinct().collect()  # at most a row a made-up row
    found = {}
    for kind in KINDS:
        own = sorted((r.score, r.p) for r in ranked if r.kind == kind)
        passing = min((x for x, p in own if p >= precision), default=None)
        if passing is not None:  # half-way to the best score below, which does not pass
            found[kind] = max(0.5, (passing + max((x for x, _ in own if x < passing), default=passing)) / 2)
    table.unpersist()
    return SpanModel(sql, {k: found.get(k, 1.1) for k in KINDS})


def detect(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``doc_id``, ``base``, ``added`` and ``passed`` for every row of ``docs``: arrays of
    ``kind, s, e, m, score``, base spans by kind and start, added ones by start, and
    where all spans that passed their thresholds lie, also those that others overlap."""
    model = model or fit(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).withColumns(base_spans(F.col("text")))
    has_digit = F.col("text").rlike("[0-9]")
    none = F.array().cast(_SPAN)
    guesses = []
    for kind, patterns in PROPOSED.items():
        some = F.col("text").rlike(r"(?i)[@\])}]| at ") if kind == "email_spelt" else has_digit
        for pattern in (patterns,) if isinstance(patterns, str) else patterns:
            guesses.append(F.when(some, spans(F.col("text"), kind, pattern)).otherwise(none))
    both = F.struct(F.concat(*(F.col(k) for k in BASE)).alias("base"), F.concat(*guesses).alias("guesses"))

    def clear(v: Column) -> Column:
        apart = bound(_in_parts(v["base"]), lambda parts: F.filter(v["guesses"], lambda g: ~_meets(parts, g)))
        return F.struct(v["base"].alias("base"), apart.alias("guesses"))

    found = found.select("doc_id", bound(both, clear).alias("v"))
    scored = F.transform("v.guesses", lambda g: F.struct(g.alias("g"), F.struct(*(c.alias(n) for c, n in zip(features(g), FEATURES, strict=True))).alias("f")))
    found = found.select("doc_id", F.col("v.base").alias("base"), scored.alias("scored"))
    limit = "CASE g.kind " + " ".join(f"WHEN '{k}' THEN {t!r}D" for k, t in model.thresholds.items()) + " ELSE 2.0D END"
    sql = model.sql.replace("f.", "x.f.")
    score = f"transform(scored, x -> struct(x.g.s AS s, x.g.e AS e, x.g.kind AS kind, x.g.m AS m, {sql} AS score, {limit.replace('g.kind', 'x.g.kind')} AS t))"
    found = found.selectExpr("doc_id", "base", f"filter({score}, x -> x.score >= x.t) AS passed")
    # of spans that overlap, the best by score stays: in order of start, a span
    # takes the place of the last one kept if it overlaps it and scores higher.
    # The list is cut where no span reaches over, and each piece is folded.  Spans
    # that lost to one which then lost itself come back, in order of start, where
    # nothing kept overlaps them, so each span that passed is kept or overlapped.
    kind = "array<struct<s:int,e:int,kind:string,m:string,score:double>>"

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        clash = (F.size(a) > 0) & (last["e"] > x["s"])
        return F.when(~clash, F.concat(a, F.array(x))).when(last["score"] < x["score"], F.concat(F.slice(a, 1, F.size(a) - 1), F.array(x))).otherwise(a)

    def best(v: Column) -> Column:
        def cut(reach: Column) -> Column:
            first = F.filter(F.sequence(F.lit(1), F.size(v)), lambda i: F.element_at(v, i)["s"] >= F.element_at(reach, i))
            return bound(first, lambda a: F.zip_with(a, F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(v) + 1)), lambda x, y: F.slice(v, x, y - x)))

        pieces = bound(_running(F.transform(v, lambda x: x["e"]), F.greatest), cut)
        folded = F.transform(pieces, lambda p: F.when(F.size(p) == 1, p).otherwise(F.aggregate(p, F.array().cast(kind), step)))
        return F.when(F.size(v) > 0, F.flatten(folded)).otherwise(F.array().cast(kind))

    def first(a: Column, x: Column) -> Column:
        return F.when((F.size(a) > 0) & (F.element_at(a, -1)["e"] > x["s"]), a).otherwise(F.concat(a, F.array(x)))

    def complete(v: Column) -> Column:
        def back(kept: Column) -> Column:
            rest = bound(_in_parts(kept), lambda parts: F.filter(v, lambda x: ~_meets(parts, x)))
            again = bound(rest, lambda r: F.aggregate(r, F.array().cast(kind), first))
            return F.when(F.size(kept) == F.size(v), kept).otherwise(F.array_sort(F.concat(kept, again)))

        return bound(best(v), back)

    plain = F.transform("passed", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["m"].alias("m"), x["score"].alias("score")))
    found = found.withColumn("plain", F.array_sort(plain))
    added = bound(F.col("plain"), complete)
    return found.select(
        "doc_id", F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"), b["m"].alias("m"), F.lit(1.0).alias("score"))).alias("base"),
        F.transform(added, lambda b: F.struct(b["kind"].alias("kind"), b["s"].alias("s"), b["e"].alias("e"), b["m"].alias("m"), b["score"].alias("score"))).alias("added"),
        F.transform("plain", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("passed"),
    )


def redact(docs: DataFrame, model: SpanModel | None = None, mark: str = "[REDACTED]") -> DataFrame:
    """``doc_id, text`` with every span replaced by ``mark``; of spans that overlap,
    what both cover is one place.  The text is cut in blocks first, so that a piece
    far into a long text is taken from its blocks and not counted out from the start."""
    model = model or fit(docs.sparkSession)
    found = detect(docs.select(F.struct("doc_id", "text").alias("doc_id"), "text"), model).withColumnRenamed("doc_id", "row")
    order = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), F.col("passed")))
    size = 2048
    found = found.select("row", order.alias("order"), F.regexp_extract_all("row.text", F.lit(f"(?s).{{1,{size}}}"), 0).alias("blocks"), F.length("row.text").alias("n"))

    def out(v: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / size).cast("int")
            own = F.array_join(F.slice(v["blocks"], first + 1, F.floor(b / size).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(own, a % size + 1, b - a)).otherwise("")

        def hidden(reach: Column) -> Column:
            before = F.slice(reach, 1, F.size(v["order"]))
            each = F.zip_with(v["order"], before, lambda x, at: F.when(x["s"] >= at, F.concat(piece(at, x["s"]), F.lit(mark))).otherwise(""))
            return F.concat(F.array_join(each, ""), piece(F.element_at(reach, -1), v["n"]))

        return bound(_running(F.transform(v["order"], lambda x: x["e"]), F.greatest), hidden)

    whole = bound(F.struct("order", "blocks", "n"), out)
    return found.select("row.doc_id", F.when(F.col("n").isNotNull(), whole).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the contract's columns for every document."""
    found = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def listed(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")

    def of_kind(column: str, kind: str) -> Column:
        return F.filter(column, lambda x: x["kind"] == kind)

    by_kind = F.concat("base", *(of_kind("added", k) for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(of_kind("base", k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(by_kind).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
