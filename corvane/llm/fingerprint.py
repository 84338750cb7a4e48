"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces.

A text is cut into sections (after blank lines), sections into paragraphs (after
line breaks), paragraphs into pieces (after sentence ends, at most PIECE code
points); nothing is left out, so the pieces end to end are the text. A piece's
digest is hashed into its paragraph's, that into its section's, that into the
root's, which is the fingerprint: equal roots mean equal texts. Where roots differ,
the first differing branch at each level locates the edit. The likeness of two trees
is twice their common leaves, counted with repeats, over all their leaves: the leaves
under the paragraphs before the first differing one are common as a whole, those under
the others are counted.

Only DataFrame functions are used. A text's tree is built once, before its row travels;
a leaf travels as 64 bits of its digest. The next document by ascending id is found in
ranges of ids: each range also gets the first row of the range after it.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = 32
SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH_END = r"(?<=\n)(?!\n)"
PIECES = rf"(?s).{{1,{PIECE - 1}}}?[.!?]\s|.{{1,{PIECE}}}"
#: A range is one task's work. MAX_RANGES only bounds how many there are, so rows in a range grow beyond 64 million rows.
ROWS_PER_RANGE, MAX_RANGES = 1024, 1 << 16
LAST = (1 << 63) - 1


def _cut(text: Column, at: str) -> Column:
    return F.filter(F.split(text, at), lambda part: part != "")


def _pieces(paragraph: Column) -> Column:
    return F.regexp_extract_all(paragraph, F.lit(PIECES), F.lit(0))


def _parent(kind: str, children: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind), F.array_join(children, "")), 256)


def piece_digests(text: Column) -> Column:
    """The digest of every piece, in order: an array for each section of an array for each paragraph of hexadecimal SHA-256."""
    paragraph = lambda p: F.transform(_pieces(p), lambda piece: F.sha2(F.concat(F.lit("L"), piece), 256))
    return F.transform(_cut(text, SECTION_END), lambda s: F.transform(_cut(s, PARAGRAPH_END), paragraph))


def paragraph_digests(pieces: Column) -> Column:
    """The digest of every paragraph over its pieces': an array for each section."""
    return F.transform(pieces, lambda s: F.transform(s, lambda p: _parent("P", p)))


def section_digests(paragraphs: Column) -> Column:
    """The digest of every section over its paragraphs'."""
    return F.transform(paragraphs, lambda s: _parent("S", s))


def root_digest(sections: Column) -> Column:
    """The root over the sections' digests: the fingerprint."""
    return _parent("R", sections)


def leaves(pieces: Column) -> Column:
    """64 bits of each piece's digest, in the same places."""
    return F.transform(pieces, lambda s: F.transform(s, lambda p: F.transform(p, lambda d: F.xxhash64(d))))


def with_tree(rows: DataFrame, text_col: str, to: str) -> DataFrame:
    """Adds a column named `to`: the text's tree, as paragraph digests by section and leaves by section and paragraph."""
    digests = f"_{to}"
    tree = F.struct(paragraph_digests(F.col(digests)).alias("paragraphs"), leaves(F.col(digests)).alias("leaves"))
    return rows.withColumn(digests, piece_digests(F.col(text_col))).withColumn(to, tree).drop(digests)


def first_difference(one: Column, other: Column) -> Column:
    """The number, from 1, of the first differing branch; 0 if none differs."""
    return F.array_position(F.zip_with(one, other, lambda a, b: ~a.eqNullSafe(b)), True)


def branch(tree: Column, number: Column) -> Column:
    """What hangs under a branch, counted from 1; nothing where there is none."""
    return F.coalesce(F.get(tree, number - 1), F.array())


def _numbered(rows: DataFrame, sorted_col: str, to: str) -> DataFrame:
    """Adds an array in which the n-th repeat of a leaf is an element of its own; the leaves are sorted."""
    s, heads = F.col(sorted_col), F.col(f"_{to}")
    last = F.size(s) - 1
    rows = rows.withColumn(f"_{to}", F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))))
    run = lambda head, k: F.transform(F.sequence(head, F.coalesce(F.get(heads, k + 1), F.size(s)) - 1), lambda j: F.xxhash64(F.get(s, j), j - head))
    return rows.withColumn(to, F.flatten(F.transform(heads, run))).drop(f"_{to}")


def with_likeness(rows: DataFrame, one: str, other: str, to: str) -> DataFrame:
    """Adds the likeness of two trees: 1 for equal texts, 0 without a common piece."""
    kept, side = rows.columns, {"a": one, "b": other}
    rows = rows.select(*kept, *(x for k, tree in side.items() for x in (F.flatten(f"{tree}.paragraphs").alias(f"_p{k}"), F.flatten(f"{tree}.leaves").alias(f"_l{k}"))))
    rows = rows.withColumn("_at", first_difference(F.col("_pa"), F.col("_pb")).cast("int"))
    # paragraphs before the first differing one are common as they are
    rows = rows.withColumn("_same", F.when(F.col("_at") == 0, F.size("_la")).otherwise(F.col("_at") - 1))
    rest = lambda k: F.sort_array(F.flatten(F.slice(f"_l{k}", F.col("_same") + 1, F.greatest(F.size(f"_l{k}") - F.col("_same"), F.lit(0)))))
    count = F.size(F.flatten(F.slice("_la", F.lit(1), F.col("_same"))))
    rows = rows.select(*kept, count.alias("_common"), rest("a").alias("_ra"), rest("b").alias("_rb"))
    for k in side:
        rows = _numbered(rows, f"_r{k}", f"_n{k}")
    common = F.col("_common") + F.size(F.array_intersect("_na", "_nb"))
    all_ = 2 * F.col("_common") + F.size("_na") + F.size("_nb")
    return rows.select(*kept, F.when(all_ == 0, F.lit(1.0)).otherwise(2.0 * common / all_).alias(to))


def _constant(values: list, kind: str) -> Column:
    """A literal array, as one constant however long it is."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, text (null as empty), the columns to carry, and next_text and next_<column> of the next row by ascending id.

    The row after the last is the first; a single row's next is itself. Rows of equal
    ids follow each other by text; null ids come after all others. Ids are integers that
    fit a long, below its two largest.
    """
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carry)
    n = rows.count()
    ranges = min(MAX_RANGES, max(1, -(-n // ROWS_PER_RANGE)))
    cuts = []
    if ranges > 1:
        wanted = _constant([i / ranges for i in range(1, ranges)], "array<double>")
        cuts = sorted(set(rows.agg(F.percentile_approx(id_col, wanted, min(100 * ranges, 1 << 20)).alias("cuts")).first().cuts or []))
    step = max(1, int(len(cuts) ** 0.5))
    coarse, fine = cuts[::step], [cuts[i : i + step] for i in range(0, len(cuts), step)]
    below = lambda array: F.size(F.filter(array, lambda c: c <= F.col(id_col)))
    if cuts:
        top = below(_constant(coarse, "array<bigint>"))
        number = F.when(top == 0, 0).otherwise((top - 1) * step + below(F.element_at(_constant(fine, "array<array<bigint>>"), F.greatest(top, F.lit(1)))))
    else:
        number = F.lit(0)
    rows = rows.withColumn("_range", F.when(F.col(id_col).isNull(), len(cuts)).otherwise(number).cast("int"))
    first = rows.groupBy("_range").agg(F.min(id_col).alias("_first")).orderBy("_range").collect()  # at most MAX_RANGES rows
    # where each range's first rows also go: the range before; those of the first range go behind the last
    moves = [(r._range, r._first, first[i - 1]._range, i == 0) for i, r in enumerate(first)]
    plan = F.broadcast(docs.sparkSession.createDataFrame(moves, "_range int, _first long, _to int, _wrap boolean"))
    rows = rows.join(plan, "_range", "left")
    is_first = F.col(id_col).eqNullSafe(F.col("_first"))
    place = F.coalesce(F.col(id_col), F.lit(LAST - 1))
    own = F.struct(F.col("_range").alias("range"), place.alias("place"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_to").alias("range"), F.when(F.col("_wrap"), F.lit(LAST)).otherwise(place).alias("place"), F.lit(True).alias("copy"))
    kept = [id_col, "text", *carry]
    rows = rows.select(*kept, F.explode(F.when(is_first, F.array(own, copy)).otherwise(F.array(own))).alias("at"))
    rows = rows.select(*kept, "at.range", "at.place", "at.copy")
    order = Window.partitionBy("range").orderBy("place", "text")
    return rows.select(*kept, *(F.lead(c).over(order).alias(f"next_{c}") for c in kept[1:]), "copy").filter(~F.col("copy")).drop("copy")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and likenesses.

    The edited text has the last floor(n_chars / 2) code points replaced by the first
    as many (or all) of the next document's. Returns id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next, n_sections,
    first_edited_section, first_edited_paragraph (inside that section) and
    first_edited_piece (inside that paragraph), each from 1; 0 if equal. Null text is empty text: no sections,
    likeness 1 to an empty text and 0 to any other. Ids are as with_next() says, order
    among equal and null ids too; other columns are ignored; an empty table gives none.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = with_tree(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "text", "tree")
    rows = with_next(rows, id_col, "text", ("tree",)).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = rows.select(id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "edited", "tree", "next_tree")
    rows = with_tree(rows, "edited", "new").drop("edited")
    rows = with_likeness(rows, "tree", "new", "near_edited")
    rows = with_likeness(rows, "tree", "next_tree", "near_next").drop("next_tree")
    # a level a step: what a step reads more than once isn't computed more than once
    rows = rows.withColumns({"s": section_digests(F.col("tree.paragraphs")), "e": section_digests(F.col("new.paragraphs"))})
    section, paragraph = F.col("first_edited_section").cast("int"), F.col("first_edited_paragraph").cast("int")
    rows = rows.withColumn("first_edited_section", first_difference(F.col("s"), F.col("e")))
    rows = rows.withColumn("first_edited_paragraph", first_difference(branch(F.col("tree.paragraphs"), section), branch(F.col("new.paragraphs"), section)))
    under = lambda tree: branch(branch(F.col(f"{tree}.leaves"), section), paragraph)
    return rows.select(
        id_col, "n_chars", "edited_sha256", root_digest(F.col("s")).alias("fingerprint"), root_digest(F.col("e")).alias("edited_fingerprint"), "near_edited", "near_next",
        F.size("s").alias("n_sections"), "first_edited_section", "first_edited_paragraph", first_difference(under("tree"), under("new")).alias("first_edited_piece"),
    )
