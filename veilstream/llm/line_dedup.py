"""Line dedup with a log-template tree, in DataFrame operations only.

A text is read as records: a line, or, of a line of LONG bytes or more, each sentence of LEAST_SENTENCE bytes or more with
the shorter ones before it, so that a passage that recurs inside a long line is found by itself and what stands
beside it stays. Tokens with a digit, an @ or a :// are
variable fields and stand as <*>. A record descends the tree by its number of tokens and its leading token to a leaf. The
leaf's templates are the masked tokens as a whole and, for lines of at least LEAST_WILD tokens, the tokens with one more
variable field: the tokens behind the leading one fall into FIELDS stretches, and each stretch in turn is the field.
Lines of a leaf that differ within one stretch thus share a template, and two thirds of their tokens or more. Each template is identified by 96 bits of hashes of its leaf and tokens.

A template recurs if documents with different ids have it; its records are dropped from all of them but the one with the
smallest id. Templates without a letter are none. Recurrence is found by one aggregation of hashes with partial sums, so
a template in most documents is no hot spot there; texts are shuffled once, to be put together without dropped records.

Defined cases: null text stays null with no lines; an empty text is one empty line, which is kept; rows with a null
doc_id keep all their lines; rows that repeat a doc_id count as one document; a record that repeats within one document
only is kept; a long line that loses all its sentences leaves an empty line; very long texts and lines are read whole;
of documents that tie for a template the smallest id keeps it; an empty table gives an empty result; other columns pass
through keep_columns unchanged, whatever their names, but n_lines and n_dropped, which are this operator's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import discard, materialize

#: Bytes of a long line and of a long sentence; tokens of a line that may have one more field; stretches that may be it.
LONG, LEAST_SENTENCE = 140, 40
LEAST_WILD = 4
FIELDS = 4
VARIABLE = r"(?<![^ \t\r\f\n])(?:[^ \t\r\f\n0-9@:]|:(?!//))*+(?:[0-9@]|://)[^ \t\r\f\n]*"  # a whole token, met at its start only
SENTENCE_END = r"(?<=[.!?] )"
SPECIAL = r"[0-9@:\t\r\f]"  # beside two spaces, what a text must have for variable fields or blanks other than single spaces


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sentences(line: Column) -> Column:
    """A long sentence with the short ones before it, and the last with those behind it too; a line without one as a whole."""

    def grouped(parts: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.octet_length(F.get(parts, k)) >= LEAST_SENTENCE)

        def joined(ends: Column) -> Column:
            def piece(k: Column) -> Column:
                start = F.when(k == 0, 0).otherwise(F.get(ends, k - 1) + 1)
                end = F.when(k == F.size(ends) - 1, F.size(parts)).otherwise(F.get(ends, k) + 1)
                return F.array_join(F.slice(parts, start + 1, end - start), "")

            return F.when(F.size(ends) == 0, F.array(line)).otherwise(F.transform(F.sequence(F.lit(0), F.size(ends) - 1), piece))

        return _bound(ends, joined)

    return _bound(F.split(line, SENTENCE_END, -1), grouped)


def records(text: Column) -> Column:
    """The records of a text with what separates them; a line ends with its line end, a part of a long line does not."""

    def parts(line: Column) -> Column:
        return F.when(F.octet_length(line) >= LONG, F.concat(_sentences(line), F.array(F.lit("\n")))).otherwise(F.array(F.concat(line, F.lit("\n"))))

    return F.flatten(F.transform(F.split(text, "\n", -1), parts))


def _hashes(*parts: Column) -> Column:
    return F.struct(F.xxhash64(*parts).alias("a"), F.hash(*parts).alias("b"))


def _wild(tokens: Column, n: Column) -> Column:
    """The templates with one stretch of the tokens behind the first as a field."""
    fields = F.least(F.lit(FIELDS), n - 1)
    at = lambda k: F.floor((n - 1) * k / fields).cast("int")

    def made(tokens: Column) -> Column:
        kept = lambda k: F.struct(k, n, F.slice(tokens, 1, at(k) + 1), F.slice(tokens, at(k + 1) + 2, n))
        return F.transform(F.transform(F.sequence(F.lit(0), fields - 1), kept), lambda part: _hashes(part))

    return _bound(F.split(tokens, " "), made)


def template_ids(rows: DataFrame) -> DataFrame:
    """rows (..., record, special) with ids: the template hashes of each record, null where it has none.

    special: whether the record's text has anything SPECIAL. Each step is a column of its own, used more than once by the
    next, so that it is worked out once for a record.
    """
    r = F.col("record")
    out = rows.withColumn("line", r.endswith("\n"))
    out = out.withColumn("plain", F.when(F.col("special") & r.rlike("[0-9@:]"), F.regexp_replace(r, VARIABLE, "<*>")).otherwise(r)).drop("record")
    out = out.withColumn("body", F.btrim("plain", F.lit(" \t\r\f\n"))).drop("plain")
    out = out.withColumn("tokens", F.when(F.col("special") & F.col("body").rlike(r"  |[\t\r\f]"), F.regexp_replace("body", r"[ \t\r\f]+", " ")).otherwise(F.col("body"))).drop("body", "special")
    first = F.ascii("tokens")
    out = out.withColumn("letters", first.between(65, 90) | first.between(97, 122) | F.col("tokens").rlike(r"\p{L}"))
    out = out.withColumn("n", F.when(F.col("letters") & F.col("line"), F.octet_length("tokens") - F.octet_length(F.replace("tokens", F.lit(" "), F.lit(""))) + 1))
    whole = F.array(_hashes(F.lit(0), F.col("tokens")))
    ids = F.when(F.col("n") >= LEAST_WILD, F.concat(whole, _wild(F.col("tokens"), F.col("n")))).when(F.col("letters"), whole)
    return out.withColumn("ids", ids).drop("tokens", "n", "line", "letters")


def _kept(text: Column, dropped: Column) -> Column:
    """text without the records at the ascending positions dropped: the stretches between them, put together."""

    def between(rows: Column) -> Column:
        after = lambda k: F.when(k == 0, F.lit(-1)).otherwise(F.get(dropped, k - 1))
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(dropped)), lambda k: F.slice(rows, after(k) + 2, F.coalesce(F.get(dropped, k), F.size(rows)) - after(k) - 1)))

    return F.regexp_replace(F.array_join(_bound(records(text), between), ""), r"\n\z", "")


def _with_drops(docs: DataFrame, id_col: str, text_col: str, carried: list[str]) -> DataFrame:
    """(__id, __text, __c0.. the carried columns, dropped: positions of the records that go, or null)."""
    src = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), *(F.col(c).alias(f"__c{k}") for k, c in enumerate(carried)))
    src = src.withColumn("__hash", F.xxhash64("__text"))
    # The outer forms, as explode alone brings a filter on its input, which would be pushed down and repeat every step.
    text = F.col("__text")
    rows = src.select("__id", "__hash", text, (text.contains("  ") | text.rlike(SPECIAL)).alias("special"))
    rows = template_ids(rows.select("__id", "__hash", "special", F.posexplode_outer(records(text)).alias("pos", "record")))
    rows = rows.select("__id", "__hash", "pos", F.explode_outer("ids").alias("t")).where("t is not null")
    rows = materialize(rows.select("__id", "__hash", "pos", "t.a", "t.b"), "templates")
    found = rows.groupBy("a", "b").agg(F.min("__id").alias("first"), F.max("__id").alias("last")).where(F.col("first") < F.col("last")).select("a", "b", "first")
    drops = rows.join(found, ["a", "b"]).where(F.col("__id") > F.col("first"))
    drops = materialize(drops.groupBy("__id", "__hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped")), "dropped")
    discard(rows)
    return src.join(drops, ["__id", "__hash"], "left").drop("__hash")


def _text() -> Column:
    return F.when(F.col("dropped").isNull(), F.col("__text")).otherwise(_kept(F.col("__text"), F.col("dropped")))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_columns: list[str] | None = None) -> DataFrame:
    """docs (id, text and keep_columns) with the recurring records gone from text, and n_lines and n_dropped."""
    carried = [c for c in keep_columns or [] if c not in (id_col, text_col, "n_lines", "n_dropped")]
    n_lines = F.octet_length("__text") - F.octet_length(F.replace("__text", F.lit("\n"), F.lit(""))) + 1
    return _with_drops(docs, id_col, text_col, carried).select(
        F.col("__id").alias(id_col),
        _text().alias(text_col),
        *(F.col(f"__c{k}").alias(c) for k, c in enumerate(carried)),
        F.coalesce(n_lines, F.lit(0)).cast("bigint").alias("n_lines"),
        F.greatest(F.size("dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, with the recurring records gone from text; without the rows of which no letter is left thereby.

    n_chars, if docs has it, counts the texts of changed rows anew.
    """
    carried = [c for c in docs.columns if c not in (id_col, text_col)]
    out = _with_drops(docs, id_col, text_col, carried).withColumn("__new", _text())
    out = out.where(F.col("dropped").isNull() | F.col("__new").rlike(r"\p{L}"))
    made = {id_col: F.col("__id"), text_col: F.col("__new")} | {c: F.col(f"__c{k}") for k, c in enumerate(carried)}
    if "n_chars" in carried:
        made["n_chars"] = F.when(F.col("dropped").isNull(), made["n_chars"]).otherwise(F.length("__new").cast(docs.schema["n_chars"].dataType))
    return out.select(*(made[c].alias(c) for c in docs.columns))
