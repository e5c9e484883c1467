"""When a file's content was made: from tags, movie headers or file times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds from 1904-01-01 to 1970-01-01; extensions of movies that have a header; first plausible year.
EPOCH_1904, FIRST_YEAR = 2_082_844_800, 1971
MOVIE_EXTENSIONS = (".3gp", ".cr3", ".m4v", ".mov", ".mp4", ".qt")
LAYOUTS = {"year": ("yyyy",), "year_month": ("yyyy", "yyyy-MM"), "year_month_day": ("yyyy", "yyyy-MM", "yyyy-MM-dd"), "flat_year_month": ("yyyy-MM",)}


def file_date(mtime: Column, birthtime: Column) -> Column:
    """The earlier of the two; a birth time of null or zero is none."""
    return F.least(mtime, F.when(F.unix_micros(birthtime) != 0, birthtime))


def plausible(when: Column, now_year: int) -> Column:
    """``when`` if its year lies between 1971 and the year after ``now_year``, else null."""
    return F.when(F.year(when).between(FIRST_YEAR, now_year + 1), when)


def tag_date(text: Column, now_year: int) -> Column:
    """``2018:12:25 08:15:00``, with anything after it; null for other text and implausible years."""
    return plausible(F.try_to_timestamp(F.substring(F.trim(text), 1, 19), F.lit("yyyy:M:d H:m:s")), now_year)


def header_date(seconds: Column, now_year: int, zone: str = "UTC") -> Column:
    """Seconds since 1904 as local time; null for 0."""
    instant = F.timestamp_seconds(F.when(seconds > 0, seconds) - EPOCH_1904)
    return plausible(F.from_utc_timestamp(instant, zone), now_year)


def capture(category: Column, ext: Column, original: Column, digitized: Column, datetime: Column, seconds: Column, now_year: int, zone: str = "UTC") -> Column:
    """``(taken, date_source)``: a header for movies, the first valid tag for photos; source ``file`` where there is none."""
    movie = ext.isin(*MOVIE_EXTENSIONS)
    tags = F.coalesce(tag_date(original, now_year), tag_date(digitized, now_year), tag_date(datetime, now_year))
    taken = F.when(movie, header_date(seconds, now_year, zone)).when(category == "photos", tags)
    source = F.when(taken.isNull(), "file").when(category == "photos", "photo").otherwise("video")
    return F.struct(taken.alias("taken"), source.alias("date_source"))


def layout_parts(when: Column, layout: str) -> list[Column]:
    """The folder names of a date layout, outermost first."""
    return [F.date_format(when, p) for p in LAYOUTS[layout]]
