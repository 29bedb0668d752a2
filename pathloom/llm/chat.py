"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds parts of kind text, image, audio or document. One visitor turns each part into its
place in the formatted string: texts are escaped, other parts become the placeholder ``<|kind|>``.
The k-th placeholder of a conversation belongs to the k-th entry of ``attachments``, which records
the reference and how many model tokens the placeholder expands to.

Template: ``<|turn|>ROLE\\nBODY<|end|>\\n``. The first character of every control string inside a
text is replaced by a two-character escape, so no text can open or close a turn, and three plain
replacements undo it.

Defined cases: null text, role or parts count as empty; a null part kind counts as text; turns sort
by turn (none first), role and text, and repeated rows are kept; long texts are formatted whole; a null conv_id is a conversation of its
own; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
ESC = "␛"
#: Control strings of common public chat templates.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
LETTER = {"<": "l", "[": "b", "\n": "n"}
PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column, role: bool = False) -> Column:
    """Reversible: afterwards the string holds no control string (and, in a role, no line end)."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit(ESC), F.lit(ESC + "e"))
    marks = [*CONTROL, "\n"] if role else CONTROL
    return reduce(lambda c, m: F.replace(c, F.lit(m), F.lit(ESC + LETTER[m[0]] + m[1:])), marks, out)


def unescape(text: Column) -> Column:
    out = reduce(lambda c, m: F.replace(c, F.lit(ESC + LETTER[m]), F.lit(m)), LETTER, text)
    return F.replace(out, F.lit(ESC + "e"), F.lit(ESC))


def text_part(text: Column) -> Column:
    """A message of one text part, for tables that hold plain text."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"),
            none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages"),
        )
    )


def is_text(part: Column) -> Column:
    return ~F.coalesce(part["kind"], F.lit("text")).isin("image", "audio", "document")


def visit(part: Column) -> Column:
    return F.when(is_text(part), escape(part["text"])).otherwise(F.concat(F.lit("<|"), part["kind"], F.lit("|>")))


def expanded_tokens(part: Column, patch: int, per_second: int, per_page: int) -> Column:
    """Image: one token a patch; audio: by duration; document: by page; at least 1."""
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / F.lit(patch))
    n = (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * per_second))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * per_page)
    )
    return F.greatest(n, F.lit(1)).cast("long")


def format_chats(messages: DataFrame, patch: int = 14, per_second: int = 25, per_page: int = 512) -> DataFrame:
    """messages (conv_id, turn, role, parts of type PART) -> one row for each conversation.

    Returns conv_id, formatted, loss_spans (start, length in code points of every assistant body),
    attachments (kind, ref, tokens) in placeholder order, and expanded_tokens, their sum.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), "parts")
    body = F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), visit), "")
    raw = F.array_join(F.transform(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: F.coalesce(p["text"], p["ref"], F.lit(""))), "")
    rows = rows.select("conv_id", "turn", "role", body.alias("body"), raw.alias("raw"), "parts")
    head = F.concat(F.lit(TURN), escape(F.col("role"), True), F.lit("\n"))
    rows = rows.withColumns({"head": head, "segment": F.concat(head, "body", F.lit(END))})
    by_turn = W.partitionBy("conv_id").orderBy("turn", "role", "raw", "body")
    before = F.sum(F.length("segment")).over(by_turn.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select(
        "conv_id", F.row_number().over(by_turn).alias("at"), "role", "segment", "parts",
        (F.coalesce(before, F.lit(0)) + F.length("head")).alias("start"), F.length("body").alias("length"),
    )
    turns = F.array_sort(F.collect_list(F.struct("at", "role", "segment", "parts", "start", "length")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == "assistant"),
        lambda t: F.struct(t["start"].cast("long").alias("start"), t["length"].cast("long").alias("length")),
    )
    attached = lambda t: F.transform(
        F.filter(F.coalesce(t["parts"], F.array().cast(f"array<{PART}>")), lambda p: ~is_text(p)),
        lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p, patch, per_second, per_page).alias("tokens")),
    )
    out = grouped.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.flatten(F.transform("turns", attached)).alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Parse formatted strings back: adds turns (role, text) and loss_text, both unescaped."""
    pieces = F.split("formatted", r"<\|turn\|>", -1)
    segments = F.filter(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda s: s != "")

    def parse(seg: Column) -> Column:
        role = F.substring_index(seg, "\n", 1)
        body = F.substring(seg, F.length(role) + 2, F.length(seg) - F.length(role) - 1 - len(END))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumns({"turns": F.transform(segments, parse), "loss_text": F.array_join(loss, "")})


def op1(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    messages = rows.unionByName(extra).withColumn("parts", text_part(F.col("text")))
    back = read_chats(format_chats(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
    )


def _count(text: str, mark: str) -> str:
    return f"(length({text}) - length(replace({text}, '{mark}', ''))) // {len(mark)}"


_TEXT, _ROLE = "coalesce(text, '')", "coalesce(role, '')"
_GROWN = " + ".join(f"{_count(t, m)}" for t in (_TEXT, _ROLE) for m in (ESC, *CONTROL)) + f" + {_count(_ROLE, '@').replace(chr(39) + '@' + chr(39), 'chr(10)')}"
OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg({_ROLE} || chr(10) || {_TEXT} || chr(10), '' ORDER BY turn NULLS FIRST, {_ROLE}, {_TEXT})) AS turns_sha256,
  CAST(coalesce(sum(length({_TEXT})) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg({_TEXT}, '' ORDER BY turn NULLS FIRST, {_ROLE}, {_TEXT}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + 1 + len(END)} + length({_ROLE}) + length({_TEXT}) + {_GROWN}) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM rows GROUP BY conv_id
"""
