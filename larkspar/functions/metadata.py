"""What a sidecar's text tells of persons, places and devices, taken out without parsing it anew."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attributes that identify a device, a place or a taste; attributes that readers need; elements that hold
# settings or a history.
IDENTIFYING = (
    r"[A-Za-z0-9_]+:(?:Body)?(?:Lens)?SerialNumber",
    r"[A-Za-z0-9_]+:GPS[A-Za-z]*",
    r"tiff:Make",
    r"tiff:Model",
    r"aux:Lens",
    r"aux:LensID",
    r"aux:LensInfo",
    r"aux:Firmware",
    r"aux:ImageNumber",
    r"aux:LensDistortInfo",
    r"exif:LensMake",
    r"xmp:Rating",
    r"xmp:Label",
)
NEEDED = ("OriginalDocumentID", "DocumentID", "RawFileName", "DateTimeOriginal", "CreateDate", "about")
SETTINGS = (
    "crs:ToneCurvePV2012",
    "crs:ToneCurvePV2012Red",
    "crs:ToneCurvePV2012Green",
    "crs:ToneCurvePV2012Blue",
    "crs:ToneCurve",
    "crs:PointColors",
    "crs:ColorVariance",
    "crs:Look",
    "xmpMM:History",
    "xmpMM:DerivedFrom",
    "exif:ISOSpeedRatings",
    "exif:Flash",
    "dc:format",
    "crs:MaskGroupBasedCorrections",
    "crs:CircularGradientBasedCorrections",
    "crs:GradientBasedCorrections",
    "crs:PaintBasedCorrections",
    "crs:RetouchAreas",
    "crd:Look",
)


def scrubbed(text: Column) -> Column:
    """A struct (text, removed): the text without identifying attributes, and their names in order, each time they stand there.

    All else is kept to the character; null for null.
    """
    named = rf"(?U)\s+({'|'.join(IDENTIFYING)})=\"[^\"]*\""
    return F.when(text.isNotNull(), F.struct(F.regexp_replace(text, named, "").alias("text"), F.regexp_extract_all(text, F.lit(named), F.lit(1)).alias("removed")))


def minimal(text: Column) -> Column:
    """The text without elements of settings and history (whole lines), and without attributes but needed ones and name spaces."""

    def without(element: str, whole: Column) -> Column:
        # The text has a name in the lambda, so that it is computed once; most elements are not there, which contains tells fast.
        gone = lambda t: F.regexp_replace(F.regexp_replace(t, rf"(?U)[ \t]*<{element}\b[^>]*/>\n", ""), rf"(?Us)[ \t]*<{element}\b.*?</{element}>\n", "")
        return F.get(F.transform(F.array(whole), lambda t: F.when(t.contains(f"<{element}"), gone(t)).otherwise(t)), F.lit(0))

    for element in SETTINGS:
        text = without(element, text)
    return F.regexp_replace(text, rf"(?U)\s+(?!xmlns:)[A-Za-z0-9_]+:(?!(?:{'|'.join(NEEDED)})=)[A-Za-z0-9]+=\"[^\"]*\"", "")
