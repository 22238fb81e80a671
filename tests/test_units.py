from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from voltlake.operators.units import Edge, UnitGraph, convert, quantity_in_text, segments_in_common_units, unit_beside, RANGE_WORDS


def test_cycles_must_agree():
    with pytest.raises(ValueError):
        UnitGraph((Edge("a", "b", Fraction(2)), Edge("b", "c", Fraction(3)), Edge("a", "c", Fraction(7))), ())
    g = UnitGraph((Edge("C", "F", Fraction(9, 5), Fraction(32)), Edge("K", "C", Fraction(1), Fraction(-27315, 100))), ())
    assert g.paths["K"]["F"] == (Fraction(9, 5), Fraction(32) - Fraction(27315, 100) * Fraction(9, 5))


def test_convert(spark):
    df = spark.createDataFrame([(1.5, "V"), (20.0, "dB"), (3.0, None), (None, "V"), (2.0, "furlong")], "v double, u string")
    got = {(r.v, r.u): r.o for r in convert(df, "v", "u", "uV", "o").collect()}
    assert got == {(1.5, "V"): 1.5e6, (20.0, "dB"): None, (3.0, None): None, (None, "V"): None, (2.0, "furlong"): None}
    assert convert(df, "v", "u", "factor", "o").where("u = 'dB'").first().o == pytest.approx(10)


@pytest.mark.parametrize("text,want", [("1 code = 0,39 uV", (0.39, "uV")), ("nV/bit: 7.8E+02", (780.0, "nV")), ("5e-07 V per code", (5e-7, "V")), ("9375nanovolt/bit", (9375.0, "nV")), ("2.5 μV/LSB", (2.5, "uV")), ("none", (None, None)), (None, (None, None))])
def test_text(spark, text, want):
    n, u = quantity_in_text(F.col("t"))
    assert tuple(spark.createDataFrame([(text,)], "t string").select(n, u).first()) == want


@pytest.mark.parametrize("text,want", [("offset of 7.0 mV seen; full-scale limits, volts", "V"), ("supply held at 3.1 V, range unit = milli-volts", "mV"), ("supply held at 3.1 V", None), ("range columns carry µV", "uV"), ("limits typed over (mV). cable 2", "mV")])
def test_note(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(unit_beside(F.col("t"), RANGE_WORDS)).first()[0] == want


def test_segments(spark):
    seg = "recording_id int, file_ord int, gain double, gain_unit string, adc_bits int, rmin double, rmax double, range_unit string, ap_scale string, note string, loaded_at string, unit_to string"
    rows = [(1, 1, 40.0, None, 1024, -0.6, 0.6, None, None, "gain [dB]", "a", "x"), (1, 1, 40.0, None, 1024, -0.6, 0.6, None, None, "gain [dB]", "b", "x"), (2, 1, 100.0, "x", 10, -600.0, 600.0, None, "2 uV", None, "a", "x"), (3, 1, None, None, None, None, None, None, None, None, "a", "x")]
    meta = spark.createDataFrame([(2, "~imAiRangeMax", "600 millivolts"), (2, "~imAiRangeMax", None)], "recording_id int, meta_key string, meta_value string")
    got = {r.recording_id: r for r in segments_in_common_units(spark.createDataFrame(rows, seg), meta).collect()}
    assert len(got) == 3
    assert (got[1].gain_factor, got[1].bits, got[1].rmax_v) == (pytest.approx(100), 10, 0.6) and got[1].scale_nv_exact == pytest.approx(1.2e9 / 1024 / 100)
    assert got[2].rmin_v == pytest.approx(-0.6) and got[2].scale_nv_exact == pytest.approx(2000)
    assert got[3].scale_nv_exact is None
    assert segments_in_common_units(spark.createDataFrame([], seg), meta).count() == 0
