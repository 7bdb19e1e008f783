"""Problem 2: oversized texts as overlapping pieces that end at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.functions.text import BLANK_CLASS, BLANKS, strip
from rankloom.operators.records import current_records
from rankloom.sources.tables import table

# Full stops that no blank follows; what belongs to the character before it; what joins the next one.
WIDE_STOPS = "。！？｡"
ATTACHED = r"[\p{M}\x{200D}\x{1F3FB}-\x{1F3FF}]"
JOINER = r"\x{200D}"


def step_pattern(limit: int, overlap: int) -> str:
    """The regular expression whose matches, end to end, are the new characters of each piece.

    Alternatives from the strongest boundary to the weakest: paragraph, line,
    sentence (a full stop before white space, or one of scripts that set none),
    blank, any character that the next one doesn't belong to (combining marks,
    joined and modified emoji), and at last any character. The first three must
    use at least half of the room, so that pieces don't become small. What is
    left and fits is taken whole. The first match may fill the limit; later
    ones leave room for the overlap. The first piece is never shorter than the
    overlap.
    """
    if not 0 < overlap <= limit // 4:
        raise ValueError("the overlap must be positive and at most a quarter of the limit")

    def ways(room: int, least: int, at: str) -> list[str]:
        half = room // 2
        ends = [(r"\n\r?\n", half, 3), (r"\n", half, 1), (rf"(?:[.!?…](?={BLANK_CLASS})|[{WIDE_STOPS}])", half, 1), (BLANK_CLASS, least - 1, 1), (rf"(?!{JOINER})[\s\S](?!{ATTACHED})", least - 1, 1)]
        return [f"{at}[\\s\\S]{{{low},{room - width}}}{end}" for end, low, width in ends]

    first, later = ways(limit, overlap, r"\A"), ways(limit - overlap, 1, r"(?!\A)")
    rest = rf"(?!\A)(?![\s\S]{{{limit - overlap + 1}}})[\s\S]+"
    return "|".join([rest, *first, rf"\A[\s\S]{{1,{limit}}}", *later, rf"[\s\S]{{1,{limit - overlap}}}"])


def pieces(text: Column, limit: int = 2048, overlap: int = 200) -> Column:
    """The pieces of ``text``, white space at both ends removed; null and blank give an empty array.

    A text within the limit is one piece. Of a longer one, every piece has at
    most ``limit`` characters (code points), consecutive pieces share exactly
    ``overlap`` characters, and without the overlaps the pieces are the text.
    One regular-expression pass cuts; the overlap is looked up in the two
    steps before (a step shorter than the overlap ends before a stretch that
    fills the next one, so two always suffice). Linear in the text's length.
    """
    t = strip(text)
    steps = F.regexp_extract_all(t, F.lit(step_pattern(limit, overlap)), F.lit(0))

    def with_overlap(steps: Column) -> Column:
        def piece(step: Column, i: Column) -> Column:
            before = F.concat(F.when(i > 1, F.get(steps, i - 2)).otherwise(""), F.get(steps, i - 1))
            return F.when(i == 0, step).otherwise(F.concat(F.right(before, F.lit(overlap)), step))

        return F.transform(steps, piece)

    return (
        F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>"))
        .when(F.length(t) <= limit, F.array(t))
        .otherwise(F.get(F.transform(F.array(steps), with_overlap), F.lit(0)))
    )


def has_stretch(text: Column, limit: int = 2048) -> Column:
    """Whether ``text`` has more than ``limit`` characters in a row without white space.

    A property of the text, by its own expression: where a stretch ends decides
    whether the cutter meets it with one of its last alternatives, and a wide
    full stop inside of it may spare them.
    """
    return F.coalesce(F.regexp_like(strip(text), F.lit(f"[^{BLANKS}]{{{limit + 1}}}")), F.lit(False))


def split_oversized(df: DataFrame, key: str, text: str, version: str, limit: int = 2048, overlap: int = 200) -> DataFrame:
    """``rec_id``, ``hard``, ``pieces`` of the current records of ``df`` that are over the limit.

    The current record of a ``key`` is its row with the latest ``version``.
    Texts are cut before the shuffle, and texts within the limit are not
    shuffled at all: their rows only carry the key and version.
    """
    long = F.length(strip(F.col(text))) > limit
    cut = df.select(
        F.col(key).cast("string").alias("rec_id"),
        F.col(version).alias("_v"),
        F.when(long, pieces(F.col(text), limit, overlap)).alias("_p"),
        F.when(long, has_stretch(F.col(text), limit).cast("int")).alias("_h"),
    )
    return current_records(cut, "rec_id", ["_v"], [F.col("_p").alias("pieces"), F.col("_h").alias("hard")]).filter("pieces IS NOT NULL")


def _both(spark: SparkSession, sf_dir: str, keep: list[str]) -> DataFrame:
    pg = split_oversized(table(spark, sf_dir, "pg_documents"), "doc_id", "content", "updated_at")
    beir = split_oversized(table(spark, sf_dir, "beir_corpus"), "_id", "text", "line_no")
    return pg.select(F.lit("pg_documents").alias("src_table"), *keep).unionByName(beir.select(F.lit("beir_corpus").alias("src_table"), *keep))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that the splitter cuts, and whether a boundary had to be forced."""
    return _both(spark, sf_dir, ["rec_id", "hard", "pieces"]).filter(F.size("pieces") > 1).select("src_table", "rec_id", "hard")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece: ``src_table``, ``rec_id``, ``piece_no`` from 1, ``piece``."""
    found = _both(spark, sf_dir, ["rec_id", "pieces"])
    return found.select("src_table", "rec_id", F.posexplode("pieces").alias("p", "piece")).select("src_table", "rec_id", (F.col("p") + 1).alias("piece_no"), "piece")


def p2_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds of every cut record: ``n_chars`` that its pieces cover without the overlaps, and whether all are within the limit and share 200 characters."""
    found = _both(spark, sf_dir, ["rec_id", "pieces"])
    sizes = F.transform("pieces", lambda p: F.length(p))
    n = F.aggregate(sizes, F.lit(0), lambda a, x: a + x) - 200 * (F.size("pieces") - 1)
    pairs = F.zip_with(F.slice("pieces", 1, F.size("pieces") - 1), F.slice("pieces", 2, F.size("pieces")), lambda a, b: F.right(a, F.lit(200)) == F.left(b, F.lit(200)))
    whole = (F.array_max(sizes) <= 2048) & F.forall(pairs, lambda x: x)
    return found.select("src_table", "rec_id", n.alias("n_chars"), whole.alias("kept"))


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_cover": p2_cover}

_TRIM = "trim({c}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"
_P2 = """
  SELECT '{t}' AS src_table, {k} AS rec_id,
         CAST(list_max(list_transform(string_split_regex(x, '[ \\t\\r\\n\\x{{00A0}}]'), lambda w: length(w))) > 2048 AS INTEGER) AS hard
  FROM (SELECT {k}, {trim} AS x FROM (
          SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {v} DESC) AS r FROM {t}) WHERE r = 1)
  WHERE length(x) > 2048"""
SQL = {
    "p2_found": _P2.format(t="pg_documents", k="doc_id", v="updated_at", trim=_TRIM.format(c="content"))
    + " UNION ALL "
    + _P2.format(t="beir_corpus", k="_id", v="line_no", trim=_TRIM.format(c="text")),
    "p2_cover": " UNION ALL ".join(
        f"SELECT '{t}' AS src_table, {k} AS rec_id, CAST(length(x) AS INTEGER) AS n_chars, true AS kept FROM (SELECT {k}, {_TRIM.format(c=c)} AS x FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {v} DESC) AS r FROM {t}) WHERE r = 1) WHERE length(x) > 2048"
        for t, k, v, c in (("pg_documents", "doc_id", "updated_at", "content"), ("beir_corpus", "_id", "line_no", "text"))
    ),
}
