"""Fill-in-the-middle: a text cut at two token ranks and put in another order, and put back.

A text is decomposed into chunks of fixed length, each with the last character of the one before. A token starts
between two characters unless both are letters, so every chunk counts its starts by itself; running sums of the counts
say which chunk owns a cut's rank, and only that chunk is looked through again for the place. The work per text is one
pass, no chunk needs more than itself, and no text leaves its row or task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A run of ASCII letters is one token, any other character is one of its own.
LETTERS, TOKEN = "[A-Za-z]+", "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
#: Of 100 documents, so many are transformed, and of 100 transformed, so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Characters of a chunk.
CHUNK = 1024


def with_chunks(df: DataFrame, text: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``__chunks``: the character before a chunk (empty for the first), the chunk, and how many tokens start in it."""
    parts = df.withColumn("__parts", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    overlapped = F.transform("__parts", lambda c, i: F.struct(F.when(i > 0, F.right(F.col("__parts")[i - 1], F.lit(1))).otherwise("").alias("before"), c.alias("chunk")))
    parts = parts.withColumn("__parts", overlapped)
    # one letter stands for a run; the character before is a token, or part of one, that the chunk before has counted
    starts = lambda c: F.length(F.regexp_replace(F.concat(c["before"], c["chunk"]), LETTERS, "a")) - F.length(c["before"])
    chunks = F.transform("__parts", lambda c: F.struct(c["before"].alias("before"), c["chunk"].alias("chunk"), starts(c).cast("long").alias("starts")))
    return parts.withColumn("__chunks", chunks).drop("__parts")


def owner_of(rank: Column) -> Column:
    """The chunk in which the token with this rank starts, counted from 0, and the starts before it, from running sums."""
    begin = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("before"))

    def step(state: Column, c: Column) -> Column:
        seen = state["seen"] + c["starts"]
        whole = seen <= rank
        return F.struct(seen.alias("seen"), (state["chunk"] + whole.cast("int")).alias("chunk"), F.when(whole, seen).otherwise(state["before"]).alias("before"))

    return F.aggregate("__chunks", begin, step)


def offset_in(owner: str, rank: Column, chunk: int = CHUNK) -> Column:
    """Characters before the token's start, from its owning chunk alone; the rank after the last token is the text's end."""
    own = F.get("__chunks", F.col(owner)["chunk"])
    # a token that began in the chunk before has no start here
    begun = F.when(own["before"].rlike("[A-Za-z]") & own["chunk"].rlike("^[A-Za-z]"), 1).otherwise(0)
    skipped = F.slice(F.regexp_extract_all(own["chunk"], F.lit(TOKEN), F.lit(0)), F.lit(1), (rank - F.col(owner)["before"]).cast("int") + begun)
    return F.col(owner)["chunk"] * chunk + F.coalesce(F.length(F.array_join(skipped, "")), F.lit(0))


def with_middle(docs: DataFrame, text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Adds ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    The cuts and the form are drawn from a hash of the doc_id: the same in every run, and a null id counts as the
    empty string. Empty and null texts and texts with a mark of their own are plain: the output is the text (empty for
    null), and the lengths are null. Prefix, middle and suffix may be empty. Rows are independent of each other, so
    repeated rows give repeated results and an empty table gives an empty one. Columns with the names of the added
    ones are replaced, all others stay.
    """
    added = ("n", "form", "prefix_chars", "middle_chars", "output")
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in added], F.coalesce(text, F.lit("")).alias("__text"))
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(drawn, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    plain = (F.col("__text") == "") | F.col("__text").rlike(MARKS) | (h[2] % 100 >= TRANSFORMED)
    form = F.when(plain, "plain").when(h[3] % 100 < SUFFIX_FIRST, "spm").otherwise("psm")
    cut = with_chunks(rows, "__text", chunk).withColumn("n", F.aggregate("__chunks", F.lit(0).cast("long"), lambda n, c: n + c["starts"])).withColumn("form", form)
    ranks = [h[0] % (F.col("n") + 1), h[1] % (F.col("n") + 1)]
    cut = cut.withColumns({"__lo": F.least(*ranks), "__hi": F.greatest(*ranks)})
    moved = F.col("form") != "plain"
    cut = cut.withColumns({o: F.when(moved, owner_of(F.col(r))) for o, r in (("__lo_at", "__lo"), ("__hi_at", "__hi"))})
    ends = {o: F.when(moved, F.least(F.length("__text"), offset_in(at, F.col(r), chunk))) for o, at, r in (("__first", "__lo_at", "__lo"), ("__second", "__hi_at", "__hi"))}
    cut = cut.withColumns(ends)
    prefix = F.substring("__text", F.lit(1), F.col("__first"))
    middle = F.substring("__text", F.col("__first") + 1, F.col("__second") - F.col("__first"))
    suffix = F.substring("__text", F.col("__second") + 1, F.length("__text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("__text"))
    )
    return cut.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in added], "n", "form", F.col("__first").cast("long").alias("prefix_chars"),
        (F.col("__second") - F.col("__first")).cast("long").alias("middle_chars"), output.alias("output"),
    )


def restored(output: str, form: str) -> Column:
    """The text that an output was made of. A transformed text has no mark of its own, so the three marks split it."""
    parts = F.split(output, MARKS, -1)
    return (
        F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.col(output))
    )
