"""Text, code and predicate functions on literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cargolore.functions import codes, predicates, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def s(value):
    return F.lit(value).cast("string")


@pytest.mark.parametrize(("raw", "clean"), [
    ("10 PCS of SS pipe", "10 pieces stainless steel pipe"), ("pump w/o seal", "pump without seal"), ("pump w/ seal", "pump seal"), ("", ""), (None, ""),
])
def test_normalize(spark, raw, clean):
    assert one(spark, text.normalize(s(raw))) == clean


def test_normalize_compat(spark):
    assert one(spark, text.normalize(s("w/o seal"), compat=True)) == "witho seal"


@pytest.mark.parametrize(("raw", "folded"), [("Müller", "Muller"), ("Société Générale", "Societe Generale"), ("Иванов", ""), (None, "")])
def test_fold(spark, raw, folded):
    assert one(spark, text.fold_unicode(s(raw))) == folded


@pytest.mark.parametrize(("raw", "bare"), [("ACME Holdings Ltd", "ACME"), ("Foo S.A.R.L.", "Foo"), ("Bar S.p.A.", "Bar")])
def test_legal_forms(spark, raw, bare):
    assert one(spark, text.strip_legal_forms(s(raw))) == bare


def test_party(spark):
    assert one(spark, text.normalize_party(s("Société Générale S.A."))) == "societe generale"


@pytest.mark.parametrize(("name", "short"), [("Smith", True), ("Lee", True), ("", True), ("Petrochemical", True), ("John Smith", False), (None, True)])
def test_short(spark, name, short):
    assert one(spark, text.is_short_name(s(name))) is short


@pytest.mark.parametrize(("raw", "materials", "n", "sure"), [
    ("1000T steel coil + 500L industrial paint", ["steel", "paint"], 2, True), ("copper wire; aluminum sheet", ["copper", "aluminum"], 2, True),
    ("copper wire and aluminum sheet", ["copper", "aluminum"], 2, True), ("a + b + c + d + e + f + g", list("abcdefg"), 1, False),
    ("steel coil + steel plate", ["steel"], 1, False), ("", [], 1, False),
])
def test_decompose(spark, raw, materials, n, sure):
    got = one(spark, text.decompose(s(raw), F.array(*(F.lit(m) for m in materials)).cast("array<string>")))
    assert len(got.fragments) == n
    assert (got.confidence >= 0.5) is sure


@pytest.mark.parametrize(("description", "aliases", "strategy", "n"), [
    ("rum, tobacco; cigars and aged spirits", [], "split_lists", 5), ("Crude oil, crude oil", ["CRUDE OIL"], "split_lists", 2),
    ("a, b, crude oil", [], "split_lists", 2), ("Iranian crude oil", ["x oil", "y oil"], "with_aliases", 3), (", ".join(f"item{i}" for i in range(14)), [], "split_lists", 10),
])
def test_phrases(spark, description, aliases, strategy, n):
    got = one(spark, text.phrases(s(description), F.array(*(F.lit(a) for a in aliases)).cast("array<string>"), s(strategy)))
    assert len(got) == n
    assert got[0] == description


def test_codes(spark):
    assert one(spark, codes.to_level(s("8542.31.00"))) == "854231"
    assert one(spark, codes.to_level(s("8542"))) == "8542"
    assert one(spark, codes.to_level(s("854"))) is None
    assert one(spark, codes.six_digits(s("85.42"))) is None
    assert one(spark, codes.found_in_html(s("see 8542.31.0001 and 1234.56."))) == ["854231", "123456"]


def test_scope_of_nulls(spark):
    rows = spark.createDataFrame([("US", "DE", None, "DE", True), (None, "DE", "US", "DE", False), (None, None, None, None, True)], "o string, d string, ro string, rd string, want boolean")
    got = rows.select(predicates.in_scope(F.col("o"), F.col("d"), F.col("ro"), F.col("rd")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


@pytest.mark.parametrize(("days", "kind", "want"), [(0, "sanctions", "green"), (7, "sanctions", "green"), (8, "sanctions", "amber"), (31, "sanctions", "red"), (60, "taxonomy", "green"), (180, "taxonomy", "amber"), (400, "taxonomy", "red"), (None, "taxonomy", "gray")])
def test_severity(spark, days, kind, want):
    assert one(spark, predicates.severity(F.lit(days).cast("int"), s(kind))) == want


def test_staleness_is_not_negative(spark):
    assert one(spark, predicates.staleness(F.lit(dt.datetime(2024, 5, 1)), dt.datetime(2024, 4, 1))) == 0
