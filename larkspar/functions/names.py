"""Names of files, frames, trips and libraries, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a camera's file name. A date that was put before it, an underscore, the body's code, a counter of four
# digits at least, the number of a virtual copy, and what a file synchronisation added.
FRAME = r"^(?:\d{8}-)?_?([A-Za-z0-9_]*?)(\d{4,})(?:-\d+)?(?:_.*)?$"
RENDER = r"-(?:Enhanced-NR|Enhanced|Panorama|Pano|HDR)(?:-\d+)?$"
TRIP = r"^(\d{4})-(\d{2})(?:-(\d{2}))?"


def frame_identity(stem: Column) -> Column:
    """(code, num) of a camera's file name, num as text with its zeros; null where it is no frame."""
    return F.when(stem.rlike(FRAME), F.struct(F.regexp_extract(stem, FRAME, 1).alias("code"), F.regexp_extract(stem, FRAME, 2).alias("num")))


def sidecar_stem(stem: Column) -> Column:
    """The stem without the decoration that a rendering adds."""
    return F.regexp_replace(stem, RENDER, "")


def is_virtual_copy(stem: Column) -> Column:
    return stem.rlike(r"-\d+$")


def trip_date(name: Column) -> Column:
    """The date that a trip's name begins with; the first of the month if it has no day; null if it is none."""
    day = F.regexp_extract(name, TRIP, 3)
    text = F.concat_ws("-", F.regexp_extract(name, TRIP, 1), F.regexp_extract(name, TRIP, 2), F.when(day == "", "01").otherwise(day))
    return F.when(name.rlike(TRIP), F.try_to_date(text, "yyyy-MM-dd"))


def trip_precision(name: Column) -> Column:
    return F.when(trip_date(name).isNotNull(), F.when(F.regexp_extract(name, TRIP, 3) == "", "month").otherwise("day"))


def days_off(captured: Column, name: Column) -> Column:
    """Days between a capture and the date of its trip; a month's trip holds all of its month."""
    folder = trip_date(name)
    by_month = F.when(F.trunc(captured, "MM") == folder, 0).otherwise(F.abs(F.date_diff(F.trunc(captured, "MM"), folder)))
    return F.when(trip_precision(name) == "month", by_month).otherwise(F.abs(F.date_diff(captured, folder)))


def library_year(library: Column) -> Column:
    """Photos-19 is 2019."""
    two = F.regexp_extract(library, r"^Photos-(\d\d)$", 1)
    return F.when(two != "", F.concat(F.lit("20"), two))


def year_label(folder: Column) -> Column:
    """What a folder's name ends with after its last hyphen, two characters as a year of this century."""
    end = F.element_at(F.split(folder, "-"), -1)
    return F.when(F.length(end) == 2, F.concat(F.lit("20"), end)).otherwise(end)


def normalise_datetime(text: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS without fractions and zone; other text trimmed."""
    pattern = r"^\s*(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2}).*$"
    return F.when(text.rlike(pattern), F.regexp_replace(text, pattern, "$1T$2")).otherwise(F.trim(text))


def path_key(url: Column) -> Column:
    """A path without scheme, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", "")


def display_path(path: Column, root: str) -> Column:
    """A path from the root on where it is inside, else as it is."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 30)).otherwise(path)


def path_parts(key: Column) -> Column:
    """(library, trip, stem) of a path: its first part, what is between, and the last."""
    parts = F.split(key, "/")
    n = F.size(parts)
    trip = F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), "/")
    return F.struct(F.element_at(parts, 1).alias("library"), trip.alias("trip"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("stem"))


def path_prefixes(key: Column) -> Column:
    """A path and all of its ancestors, the longest first."""
    parts = F.split(key, "/")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def stem_bases(stem: Column) -> Column:
    """A stem and what is left of it when -segments are dropped from its end, the longest first."""
    parts = F.split(stem, "-")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "-"))
