"""Queries of scalar functions: texts, codes, names, conditions (§2.3, §2.9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolore.functions import codes, predicates, text
from cargolore.functions.text import LEGAL_FORMS, STOP_WORDS
from cargolore.operators.screening import combine, phrases_of

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
# Goods of the six entity labels used for decomposition.
MATERIALS = ("steel", "brass", "copper", "green", "blue", "red", "small", "large")


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ({_STOP}))"


def trigrams_sql(x: str) -> str:
    words = f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
    return f"list_distinct(flatten(list_transform(list_transform({words}, lambda w: '  ' || w || ' '), lambda w: list_transform(range(1, length(w) - 1), lambda i: substring(w, i, 3)))))"


def lexemes_sql(x: str, config: str = "english") -> str:
    """Lexemes by position; the tables' words have two stems other than themselves."""
    words = f"list_filter(string_split_regex(lower(coalesce({x}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
    stems = "CASE w WHEN 'economy' THEN 'economi' WHEN 'large' THEN 'larg' WHEN 'the' THEN '' WHEN 'of' THEN '' ELSE w END"
    return f"list_transform({words}, lambda w: {stems})" if config == "english" else words


def covers_sql(queries: str, docs: str, config: str = "english", name: str = "rk") -> str:
    """CTEs that end in ``name`` (``query_id, key, rank``) of ``queries`` (``query_id, text``) and
    ``docs`` (``key, text``): all runs from one term to another that hold all terms, less those
    that hold another of them."""
    n = name
    return f"""{n}q AS MATERIALIZED (SELECT query_id, list_distinct(list_filter({lexemes_sql("text", config)}, lambda w: w <> '')) AS q FROM ({queries})),
{n}d AS MATERIALIZED (SELECT key, {lexemes_sql("text", config)} AS w FROM ({docs})),
{n}e AS MATERIALIZED (SELECT query_id, key, len(q) AS n, i, w[i] AS t FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM {n}q JOIN {n}d ON len(q) > 0 AND list_has_all(w, q)) WHERE list_contains(q, w[i])),
{n}r AS (SELECT a.query_id, a.key, a.i AS a, b.i AS b, count(*) AS m FROM {n}e AS a JOIN {n}e AS b ON a.query_id = b.query_id AND a.key = b.key AND a.i <= b.i JOIN {n}e AS x ON x.query_id = a.query_id AND x.key = a.key AND x.i BETWEEN a.i AND b.i GROUP BY ALL HAVING count(DISTINCT x.t) = any_value(a.n)),
{n} AS (SELECT query_id, key, round(sum(0.1::DOUBLE / (1 + (b - a + 1) - m)), 9) AS rank FROM {n}r AS r WHERE NOT EXISTS (SELECT 1 FROM {n}r AS o WHERE o.query_id = r.query_id AND o.key = r.key AND o.a >= r.a AND o.b <= r.b AND (o.a > r.a OR o.b < r.b)) GROUP BY ALL)"""


def similarity_sql(a: str, b: str) -> str:
    """Shared over all elements of two lists of distinct values."""
    both, one, two = f"len(list_intersect({a}, {b}))", f"len({a})", f"len({b})"
    return f"coalesce({both}::DOUBLE / nullif({one} + {two} - {both}, 0), 0.0)"


def logit_sql(q: str, t: str) -> str:
    return f"(6 * (0.6 * {similarity_sql(f'list_distinct({words_sql(q)})', f'list_distinct({words_sql(t)})')} + 0.4 * {similarity_sql(trigrams_sql(q), trigrams_sql(t))}) - 3)"


def _abbreviated(t):  # noqa: ANN001, ANN202
    """Descriptions with abbreviations put in by rule."""
    return t["part"].select("p_partkey", F.concat(F.lit("The "), "p_name", F.lit("  10 Pcs. W/O qty & fin ("), "p_type", F.lit(") SS of cu-plate, W/ case")).alias("raw"))


_NORMAL = "lower(trim('The ' || p_name || '  10 Pcs. W/O qty & fin (' || p_type || ') SS of cu-plate, W/ case'))"
_NORMAL = f"regexp_replace({_NORMAL}, '[^\\w\\s/%.\\-,]', ' ', 'g')"
_NORMAL = f"regexp_replace({_NORMAL}, '\\bw/o\\b', 'without', 'g')"
_NORMAL = f"replace(replace({_NORMAL}, 'w/ ', 'with '), '\\bw/\\b', 'with ')"
for _s, _f in text.ABBREVIATIONS[2:]:
    _NORMAL = f"regexp_replace({_NORMAL}, '\\b{_s}\\b', '{_f}', 'g')"
_NORMAL = f"array_to_string(list_filter(string_split_regex(trim(regexp_replace({_NORMAL}, '\\s+', ' ', 'g')), ' '), lambda w: w <> '' AND w NOT IN ({_STOP})), ' ')"

_FORMS = "|".join(sorted(LEGAL_FORMS, key=len, reverse=True))


def _party_sql(x: str) -> str:
    for _ in range(6):
        # no lookahead in the comparison engine: the sign after a form is put back
        x = f"trim(regexp_replace(regexp_replace({x}, '(?i)\\b(?:{_FORMS})(\\W|$)', '\\1', 'g'), '[\\s.,;:!?\\-]+$', ''))"
    return f"trim(regexp_replace(lower({x}), '\\s+', ' ', 'g'))"


_NAMED = "CASE s_suppkey % 4 WHEN 0 THEN s_name || ' Holdings Ltd.' WHEN 1 THEN 'Foo ' || s_name || ' S.p.A.' WHEN 2 THEN s_name || ' Trading GmbH, Inc' ELSE 'Lee' END"
_ACCENTED = _NAMED.replace("'Foo '", "'Fóö ø '").replace("'Lee'", "'Señora Zoë SA'")
_FOLDED = f"regexp_replace(strip_accents({_ACCENTED}), '[^\\x00-\\x7F]', '', 'g')"


def _decomposed(t):  # noqa: ANN001, ANN202
    raw = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('100 ', p_name, ' sheets + 20 steel coils') WHEN 1 THEN concat(p_name, ' and copper wire; ', p_type) WHEN 2 THEN concat(p_name, ', brass tube, ', p_type) ELSE p_name END")
    rows = t["part"].select("p_partkey", raw.alias("raw")).withColumn("d", text.decompose(F.col("raw"), F.array(*(F.lit(m) for m in MATERIALS))))
    return rows.select("p_partkey", F.round("d.confidence", 6).alias("confidence"), F.array_join(F.transform("d.fragments", lambda x: x["text"]), "|").alias("fragments"), F.size("d.fragments").alias("n"))


_MATERIAL_LIST = "[" + ", ".join(f"'{m}'" for m in MATERIALS) + "]"
_DECOMPOSE = f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '100 ' || p_name || ' sheets + 20 steel coils' WHEN 1 THEN p_name || ' and copper wire; ' || p_type WHEN 2 THEN p_name || ', brass tube, ' || p_type ELSE p_name END AS raw FROM part),
h AS (SELECT *, list_filter(list_transform(string_split_regex(raw, '(?i)\\s*(?:[+&;]|/|\\bplus\\b|\\band\\b)\\s*'), lambda p: trim(p)), lambda p: p <> '') AS hard,
      list_filter(list_transform(string_split_regex(raw, '\\s*,\\s*'), lambda p: trim(p)), lambda p: p <> '') AS soft FROM r),
f AS (SELECT *, list_filter(CASE WHEN len(hard) > 1 THEN hard ELSE soft END, lambda p: length(p) >= 5) AS parts FROM h),
g AS (SELECT *, list_filter(parts, lambda p: len(list_filter({_MATERIAL_LIST}, lambda m: contains(lower(p), m))) > 0) AS held,
      len(list_distinct(flatten(list_transform(parts, lambda p: list_filter({_MATERIAL_LIST}, lambda m: contains(lower(p), m)))))) AS k FROM f),
s AS (SELECT *, len(parts) BETWEEN 2 AND 5 AND len(held) >= 2 AND k >= 2 AS several FROM g)
SELECT p_partkey, CASE WHEN several THEN round(least(1.0, 0.4 + 0.2 * k), 6)::DOUBLE ELSE 0.0 END AS confidence, CASE WHEN several THEN array_to_string(held, '|') ELSE raw END AS fragments, CASE WHEN several THEN len(held) ELSE 1 END::INT AS n FROM s"""


def _conditions(t):  # noqa: ANN001, ANN202
    s = t["shipment"]
    none = "cast(null as map<string,string>)"
    cond = F.expr(f"""CASE l_orderkey % 4 WHEN 0 THEN named_struct('min_value', 30000d, 'max_value', cast(null as double), 'currency_in', cast(null as array<string>), 'metadata_eq', {none})
        WHEN 1 THEN named_struct('min_value', cast(null as double), 'max_value', 20000d, 'currency_in', array('USD', 'EUR'), 'metadata_eq', {none})
        WHEN 2 THEN named_struct('min_value', cast(null as double), 'max_value', cast(null as double), 'currency_in', cast(null as array<string>), 'metadata_eq', map('mode', 'air')) ELSE named_struct('min_value', cast(null as double), 'max_value', cast(null as double), 'currency_in', cast(null as array<string>), 'metadata_eq', {none}) END""")
    meta = F.expr("CASE WHEN query_id % 2 = 0 THEN map('mode', 'air') WHEN query_id % 3 = 0 THEN map('mode', 'sea') END")
    value = F.expr("CASE WHEN query_id % 7 = 0 THEN NULL ELSE value END")
    return s.select("query_id", predicates.satisfied(cond, value, F.col("currency"), meta).alias("ok"))


_CONDITIONS = """SELECT query_id, CASE l_orderkey % 4 WHEN 0 THEN query_id % 7 <> 0 AND value >= 30000 WHEN 1 THEN query_id % 7 <> 0 AND value <= 20000 AND currency IN ('USD', 'EUR') WHEN 2 THEN query_id % 2 = 0 ELSE TRUE END AS ok FROM shipment"""


def _combined(t):  # noqa: ANN001, ANN202
    rows = t["screening"].select("rule_id", "phrase", F.struct("mode", F.col("group_phrases").alias("phrases")).alias("phrase_group"))
    lengths = F.transform("all_phrases", lambda p: F.length(p) / 100.0)
    return phrases_of(rows).select("rule_id", "mode", F.size("all_phrases").alias("n"), F.round(combine(lengths, F.col("mode")), 4).cast("double").alias("value"))


QUERIES = {
    "normalize_text": (lambda t: _abbreviated(t).select("p_partkey", text.normalize(F.col("raw")).alias("clean")), f"SELECT p_partkey, {_NORMAL} AS clean FROM part"),
    "normalize_code": (
        lambda t: t["codes"].select("p_partkey", *(f(F.expr("concat(substring(hs_code, 1, 4), '.', substring(hs_code, 5, 1 + p_partkey % 2), CASE WHEN p_partkey % 3 = 0 THEN '.00' ELSE '' END)")).alias(n) for n, f in (("digits", codes.digits), ("level_code", codes.to_level), ("six", codes.six_digits)))),
        """WITH d AS (SELECT p_partkey, regexp_replace(substring(hs_code, 1, 4) || '.' || substring(hs_code, 5, (1 + p_partkey % 2)::INT) || CASE WHEN p_partkey % 3 = 0 THEN '.00' ELSE '' END, '[^0-9]', '', 'g') AS digits FROM codes)
        SELECT p_partkey, digits, CASE WHEN length(digits) >= 6 THEN substring(digits, 1, 6) WHEN length(digits) IN (2, 4) THEN digits END AS level_code, CASE WHEN length(digits) >= 6 THEN substring(digits, 1, 6) END AS six FROM d"""),
    "split_codes": (
        lambda t: t["codes"].select("p_partkey", F.array_join(codes.level_codes(codes.split_codes(F.expr("concat(hs_code, ' ; ', substring(hs_code, 1, 4), '/', hs_code, ',12.3, ')"))), ",").alias("codes")),
        "SELECT p_partkey, hs_code || ',' || substring(hs_code, 1, 4) AS codes FROM codes"),
    "code_prefixes": (lambda t: t["codes"].select("p_partkey", F.array_join(codes.prefixes(F.col("hs_code")), ",").alias("prefixes")), "SELECT p_partkey, substring(hs_code, 1, 2) || ',' || substring(hs_code, 1, 4) || ',' || hs_code AS prefixes FROM codes"),
    "normalize_party": (lambda t: t["supplier"].select("s_suppkey", text.normalize_party(F.expr(_ACCENTED)).alias("party")), f"SELECT s_suppkey, {_party_sql(_FOLDED)} AS party FROM supplier"),
    "is_short_name": (lambda t: t["supplier"].select("s_suppkey", text.is_short_name(F.expr(_NAMED)).alias("short")), f"SELECT s_suppkey, len(string_split_regex({_NAMED}, '\\s+')) < 2 OR length(replace({_NAMED}, ' ', '')) < 4 AS short FROM supplier"),
    "fold_unicode": (lambda t: t["documents"].select("doc_id", text.fold_unicode(F.col("text")).alias("folded")), "SELECT doc_id, regexp_replace(strip_accents(coalesce(text, '')), '[^\\x00-\\x7F]', '', 'g') AS folded FROM documents"),
    "trigram_similarity": (
        lambda t: t["part"].select("p_partkey", F.round(text.trigram_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity")),
        f"SELECT p_partkey, round({similarity_sql(trigrams_sql('p_name'), trigrams_sql('p_type'))}, 6) AS similarity FROM part"),
    "decompose_text": (_decomposed, _DECOMPOSE),
    "candidate_text": (
        lambda t: t["taxonomy"].select("hs_code", text.candidate_text(F.col("hs_code"), F.col("chapter"), F.col("title"), F.expr("CASE WHEN level = 4 THEN title ELSE description END")).alias("line")),
        "SELECT hs_code, 'HS ' || hs_code || ' (ch ' || chapter || '): ' || title || CASE WHEN level = 4 THEN '' ELSE ' ' || description END AS line FROM taxonomy"),
    "phrases": (
        lambda t: t["part"].select("p_partkey", F.array_join(text.phrases(F.expr("concat(p_name, ', ', p_type, ' and ', p_brand, '; ab')"), F.array(F.upper("p_type"), F.lit("alias one")), F.expr("CASE p_partkey % 3 WHEN 0 THEN 'description_only' WHEN 1 THEN 'with_aliases' ELSE 'split_lists' END")), "|").alias("phrases")),
        """SELECT p_partkey, p_name || ', ' || p_type || ' and ' || p_brand || '; ab' || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '|' || upper(p_type) || '|alias one'
           ELSE '|' || p_name || '|' || p_type || '|' || p_brand || '|alias one' END AS phrases FROM part"""),
    "rule_conditions": (_conditions, _CONDITIONS),
    "rule_any_all": (
        _combined,
        """WITH r AS (SELECT rule_id, CASE WHEN group_phrases IS NULL THEN 'single' WHEN mode IN ('any_of', 'all_of') THEN mode ELSE 'any_of' END AS mode, coalesce(group_phrases, [phrase]) AS p FROM screening)
        SELECT rule_id, mode, len(p)::INT AS n, round(CASE WHEN mode = 'all_of' THEN list_min(list_transform(p, lambda x: length(x))) ELSE list_max(list_transform(p, lambda x: length(x))) END / 100.0, 4)::DOUBLE AS value FROM r"""),
    "iso_codes": (
        lambda t: t["customer"].select("c_custkey", predicates.iso(F.expr("CASE c_custkey % 4 WHEN 0 THEN ' us ' WHEN 1 THEN 'DEU' WHEN 2 THEN 'f1' ELSE 'Fr' END")).alias("iso")),
        "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'US' WHEN 3 THEN 'FR' END AS iso FROM customer"),
    "rule_input_errors": (
        lambda t: t["part"].select("p_partkey", F.array_join(predicates.rule_errors({"name": F.expr("CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END"), "phrase": F.expr("substring(p_type, 1, p_partkey % 6)"), "threshold": F.expr("(p_partkey % 13) / 10.0"), "phrases": F.expr("CASE WHEN p_partkey % 2 = 0 THEN array_repeat(p_name, cast(p_partkey % 12 as int)) END")}), ",").alias("errors")),
        """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 0 THEN 'name' END, CASE WHEN least(length(p_type), p_partkey % 6) < 3 THEN 'phrase' END, CASE WHEN p_partkey % 13 > 10 THEN 'threshold' END,
           CASE WHEN p_partkey % 2 = 0 AND p_partkey % 12 NOT BETWEEN 1 AND 10 THEN 'phrases' END], lambda e: e IS NOT NULL), ',') AS errors FROM part"""),
    "list_names": (
        lambda t: t["part"].select("p_partkey", predicates.valid_list_name(F.lower(F.regexp_replace("p_name", " ", F.when(F.col("p_partkey") % 2 == 0, "_").otherwise(" ")))).alias("ok")),
        "SELECT p_partkey, p_partkey % 2 = 0 AND length(p_name) <= 29 AS ok FROM part WHERE p_name LIKE '% %' UNION ALL SELECT p_partkey, length(p_name) <= 29 FROM part WHERE p_name NOT LIKE '% %'"),
}
