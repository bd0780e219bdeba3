"""Initials of native names, and sidecars without what identifies."""

from pyspark.sql import functions as F

from larkspar.functions import labels as L
from larkspar.functions import metadata


def initials(spark, names, **more):
    rows = spark.createDataFrame(list(enumerate(names)), "i int, name string")
    return [r.x for r in rows.orderBy("i").select(L.pinyin_initials(F.col("name"), **more).alias("x")).collect()]


def test_initials_of_every_letter(spark):
    # One character for each letter that a syllable begins with.
    letters = {"鹌": "a", "斑": "b", "翠": "c", "雕": "d", "鹗": "e", "凤": "f", "鸽": "g", "鹤": "h", "鸡": "j", "孔": "k", "鹭": "l", "猫": "m", "鸟": "n", "鸥": "o", "琵": "p", "雀": "q", "人": "r", "山": "s", "鹈": "t", "鹟": "w", "小": "x", "燕": "y", "朱": "z"}
    assert initials(spark, letters) == list(letters.values())


def test_initials_keep_what_is_not_read(spark):
    assert initials(spark, ["", None, "Abc 麻雀-2", "灰雀\n", "\U00020000雀", "黄嘴栗啄木鸟"]) == ["", None, "abc mq-2", "hq\n", "\U00020000q", "hzlzmn"]


def test_readings_of_characters_are_a_parameter(spark):
    assert initials(spark, ["长耳鸮"]) == ["cex"] and initials(spark, ["长耳鸮"], readings={}) == ["zex"] and initials(spark, ["重庆"], readings={"重": "c"}) == ["cq"]


def test_confidences_are_rounded_as_their_exact_value(spark):
    values = [0.0, 0.00125, 0.5, 1.0, 1.005, 12.345, 95.0, 99.999, 1234.5, -3.0]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c double").orderBy("i")
    got = [r.x for r in rows.select(L.initials_label(F.lit("雀"), F.col("c")).alias("x")).collect()]
    assert got == [f"q ({v * 100 if 0 <= v <= 1 else v:.2f}%)" for v in values]


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_identifying_attributes_go_and_all_else_stays(spark):
    kept = '<r:D\n  xmlns:aux="u"\n  crs:Version="15.0" exif:DateTimeOriginal="2023-01-02" aux:LensX="no" note="tiff:Make=1">a tiff:Model="x</r:D>\n'
    text = kept.replace("\n  crs:", '\n  exif:GPSLatitude="31,2N"\n\taux:LensSerialNumber="" exifEX:BodySerialNumber="7"\n  xmp:Label="Red"\n  crs:')
    got = one(spark, text, metadata.scrubbed)
    assert got.text == kept and got.removed == ["exif:GPSLatitude", "aux:LensSerialNumber", "exifEX:BodySerialNumber", "xmp:Label"]
    assert one(spark, kept, metadata.scrubbed).removed == [] and one(spark, "", metadata.scrubbed).text == "" and one(spark, None, metadata.scrubbed) is None


def test_a_long_sidecar_is_scrubbed(spark):
    settings = "".join(f'\n   crs:S{i}="{i}"' for i in range(20_000))
    text = f'<r:D r:about=""{settings}\n   tiff:Model="m">\n<crs:Look>{"x" * 500_000}</crs:Look>\n</r:D>'
    assert one(spark, text, metadata.scrubbed).removed == ["tiff:Model"]
    assert one(spark, text, metadata.minimal) == '<r:D r:about="">\n</r:D>'


def test_minimal_keeps_what_readers_need(spark):
    text = (
        '<x:m xmlns:x="a" x:xmptk="t">\n <rdf:D rdf:about="" xmlns:crs="b"\n  xmpMM:DocumentID="1" xmpMM:DocumentIDs="2" crs:RawFileName="r.nef" xmp:CreateDate="d" crs:A="1">\n'
        "  <crs:ToneCurve/>\n  <crs:ToneCurvePV2012>\n   <rdf:li>1</rdf:li>\n  </crs:ToneCurvePV2012>\n"
        '  <crs:ToneCurves crs:B="1">k</crs:ToneCurves>\n  <dc:format>image</dc:format> \n  <dc:subject>\n   <rdf:li>bird</rdf:li>\n  </dc:subject>\n </rdf:D>\n</x:m>'
    )
    want = (
        '<x:m xmlns:x="a">\n <rdf:D rdf:about="" xmlns:crs="b"\n  xmpMM:DocumentID="1" crs:RawFileName="r.nef" xmp:CreateDate="d">\n'
        "  <crs:ToneCurves>k</crs:ToneCurves>\n  <dc:format>image</dc:format> \n  <dc:subject>\n   <rdf:li>bird</rdf:li>\n  </dc:subject>\n </rdf:D>\n</x:m>"
    )
    assert one(spark, text, metadata.minimal) == want and one(spark, None, metadata.minimal) is None
