"""Column expressions on paths, names, marks' texts and costs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def labels_path(pdf: Column, data: str) -> Column:
    """Where the labels of a PDF lie: under data, by the name of the folder that holds its `sources` (the nearest one above it) and
    the path from there; null for a PDF that is in none."""
    found = F.regexp_extract(pdf, r"(?s)^(?:.*/)?([^/]+)/(sources/(?:(?!sources/).)*)\.[^./]*$", 1)
    rest = F.regexp_extract(pdf, r"(?s)^(?:.*/)?([^/]+)/(sources/(?:(?!sources/).)*)\.[^./]*$", 2)
    return F.when(found != "", F.concat_ws("/", F.lit(data), found, F.concat(rest, F.lit(".labels.json"))))


def labelled_pdf(file: Column, data: str, edition: Column) -> tuple[Column, Column]:
    """(edition's name, PDF) of a labels file under data: the other way round of labels_path, in the edition's folder."""
    inner = F.regexp_replace(file, r"^(?:file:/+)?/?" + data.strip("/") + "/", "")
    name = F.split_part(inner, F.lit("/"), F.lit(1))
    rel = F.regexp_replace(F.substring(inner, F.length(name) + 2, F.length(inner)), r"\.labels\.json$", ".pdf")
    return name, F.concat_ws("/", edition, rel)


def structure_path(edition: Column, work: Column) -> Column:
    """Where the structure text of a work such as "Op. 48/1, G 226" lies in an edition; null for a work without such a number."""
    number = lambda k: F.regexp_extract(work, r"Op\.\s*(\d+)\s*/\s*(\d+)", k)
    return F.when(number(1) != "", F.concat(edition, F.lit("/Op"), number(1), F.lit("-"), number(2), F.lit("/Structure.ily")))


def file_identity(size: Column, modified: Column) -> Column:
    """What a cached answer about a file holds for: its size and the time of its last change, in nanoseconds."""
    return F.concat_ws(":", size.cast("string"), (F.unix_micros(modified) * 1000).cast("string"))


def cache_file(key: Column, edition: Column, rel: Column) -> Column:
    """The cached answers of a detector (key) about a file of an edition: the edition by name and the start of its path's hash, the
    file in one name."""
    name = F.element_at(F.split(edition, "/"), -1)
    folder = F.concat(name, F.lit("-"), F.substring(F.sha1(edition), 1, 8))
    return F.concat(F.lit("detections/"), key, F.lit("/"), folder, F.lit("/"), F.regexp_replace(rel, "/", "__"), F.lit(".json"))


def text_norm(text: Column) -> Column:
    """A mark's text as compared: lower case, without accents, punctuation, blanks and controls; a degree sign or ring is an
    ordinal's o; other symbols stay. Letters of the Latin alphabets lose their accents; other compositions stay as they are."""
    plain = F.translate(F.lower(F.translate(text, "°˚º", "ooo")), ACCENTED, PLAIN)
    for many, few in LIGATURES.items():
        plain = F.replace(plain, F.lit(many), F.lit(few))
    return F.regexp_replace(plain, r"[\p{M}\p{P}\p{Z}\p{Cc}\p{Cf}]", "")


#: Letters with accents and their bare letters, by the decomposition that Unicode gives them.
def _decomposed() -> tuple[str, str, dict[str, str]]:
    import unicodedata

    from_, to, more = [], [], {}
    for c in map(chr, [*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]):
        low = c.lower()
        bare = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))
        if bare == low or not bare.strip():
            continue
        if len(bare) == 1 and len(low) == 1:
            from_.append(low)
            to.append(bare)
        else:
            more[low] = bare
    return "".join(dict.fromkeys(from_)), "".join(dict(zip(from_, to, strict=True)).values()), more


ACCENTED, PLAIN, LIGATURES = _decomposed()


def quoted(text: Column) -> Column:
    """A text in quotes, as a structure text holds it."""
    return F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def cost(prices: dict[str, tuple[float, float]], model: Column, read: Column, written: Column) -> Column:
    """Dollars of a use of a model: tokens read and written at its prices a million; null for a model without a price."""
    of = lambda k: F.create_map(*[F.lit(x) for m, p in prices.items() for x in (m, p[k])])[model]
    return (read * of(0) + written * of(1)) / 1_000_000


def next_id(ids: Column, prefix: str) -> Column:
    """The next free id with a prefix and a number: one more than the greatest there is (1 without any)."""
    number = lambda i: F.nullif(F.regexp_extract(i, f"^{prefix}([0-9]+)$", 1), F.lit("")).cast("long")
    top = F.coalesce(F.array_max(F.transform(ids, number)), F.lit(0))
    return F.concat(F.lit(prefix), (top + 1).cast("string"))


def paper_edges(corners: Column, y: Column) -> tuple[Column, Column]:
    """(left, right) edge of the paper at height y: along the sides between its corners (top left, top right, bottom right,
    bottom left, each [x, y]), carried on beyond them."""
    at = lambda k, c: F.get(F.get(corners, F.lit(k)), F.lit(c))

    def side(top: int, bottom: int) -> Column:
        x0, y0, x1, y1 = at(top, 0), at(top, 1), at(bottom, 0), at(bottom, 1)
        return F.when(y1 == y0, x0).otherwise(x0 + (x1 - x0) * (y - y0) / (y1 - y0))

    return side(0, 3), side(1, 2)
