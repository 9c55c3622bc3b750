"""Chat formatting with typed content parts (DataFrame functions only).

A turn's content is a list of parts, struct<kind, text, ref, units>. The visitor (flatten_parts) walks the list in order:
text goes in escaped, an image, audio or document part becomes one placeholder and leaves an attachment record (ordinal,
kind, ref, token count, and the text that it stood for). A placeholder later expands to as many tokens as its kind and units ask for. typed_parts() cuts a plain text into
such parts where it carries media: ![alt](ref) whose ref ends as an image, audio or document file does; a number after a bar at the end of alt gives the units, else one.

Template of a turn:     <s>ROLE[INST]CONTENT</s>      for roles that are not trained on
                        <s>ROLE[/INST]CONTENT</s>     for the assistant, whose CONTENT is under the loss mask

Texts and roles can hold any of the control strings; escape() turns each into a two-character code led by "~" (and "~" itself into
"~t"), unescape() turns it back, so parse() reads any formatted conversation back exactly; restore() puts what media stood for back first.

A conversation is formatted in chunks of CHUNK turns, grouped by conversation and chunk, and then joined, so that
a hot conversation's turns are not gathered row by row in one task. Its one string is what is asked for and must fit in memory.

Defined cases: a null text or part list is empty; a null role is the empty role; turns are in order of turn, null first, ties by role, then
text; repeated rows are turns of their own; parts of unknown kind are text, and a link to another kind of file stays text; units that are null or negative are 0; a null conv_id is one
conversation; very long texts go in whole; extra columns, also of clashing names, are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.llm.common import table

CHUNK = 64
#: Control strings and their codes.
CODES = (("</s>", "~e"), ("<s>", "~s"), ("[INST]", "~i"), ("[/INST]", "~o"), ("<image>", "~p"), ("<audio>", "~a"), ("<document>", "~d"))
#: Tokens of a placeholder: a fixed count and a count for each unit (image tiles, seconds of audio, document pages).
EXPANSION = {"image": (2, 256), "audio": (2, 25), "document": (2, 1024)}
TRAINED_ROLE = "assistant"
#: Endings of files by kind, and what a link to one looks like: alt, ref, ending.
FILES = {"image": ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff"), "audio": ("mp3", "wav", "ogg", "flac", "m4a"), "document": ("pdf", "doc", "docx", "ppt", "pptx", "epub")}
MEDIA = r"!\[([^\[\]\n]{0,200})\]\(([^()\s]{1,500}\.(" + "|".join(e for ends in FILES.values() for e in ends) + r"))\)"
_HOLDERS = "<(?:" + "|".join(FILES) + ")>"

PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("~"), F.lit("~t"))
    for control, code in CODES:
        out = F.replace(out, F.lit(control), F.lit(code))
    return out


def unescape(text: Column) -> Column:
    out = text
    for control, code in reversed(CODES):
        out = F.replace(out, F.lit(code), F.lit(control))
    return F.replace(out, F.lit("~t"), F.lit("~"))


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin(*EXPANSION), part["kind"])


def visit(part: Column) -> Column:
    """What a part puts into the text: its placeholder, or its escaped text."""
    kind = _kind(part)
    return F.when(kind.isNotNull(), F.concat(F.lit("<"), kind, F.lit(">"))).otherwise(escape(F.coalesce(part["text"], F.lit(""))))


def expanded_tokens(part: Column) -> Column:
    kind, units = _kind(part), F.greatest(F.coalesce(part["units"], F.lit(0)), F.lit(0))
    out = F.lit(0).cast("long")
    for name, (fixed, each) in EXPANSION.items():
        out = F.when(kind == name, F.lit(fixed).cast("long") + units * each).otherwise(out)
    return out


def flatten_parts(parts: Column) -> Column:
    """struct<content, attachments: array<struct<ordinal, kind, ref, tokens, source>>> of a list of parts."""
    media = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: _kind(p).isNotNull())
    content = F.array_join(F.transform(F.coalesce(parts, F.array().cast(PARTS)), visit), "")
    records = F.transform(media, lambda p, i: F.struct(i.cast("long").alias("ordinal"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"), F.coalesce(p["text"], F.lit("")).alias("source")))
    return F.struct(content.alias("content"), records.alias("attachments"))


def text_parts(text: Column) -> Column:
    """The part list of a turn that is plain text."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def typed_parts(text: Column) -> Column:
    """The part list of a turn whose text may carry media: text and media in turn."""
    text = F.coalesce(text, F.lit(""))
    null = lambda kind: F.lit(None).cast(kind)
    words = F.transform(F.split(text, MEDIA, -1), lambda t: F.struct(F.lit("text").alias("kind"), t.alias("text"), null("string").alias("ref"), null("bigint").alias("units")))

    def media(found: Column) -> Column:
        ending = F.regexp_extract(found, MEDIA, 3)
        kind = F.when(ending.isin(*FILES["image"]), "image").when(ending.isin(*FILES["audio"]), "audio").otherwise("document")
        units = F.coalesce(F.nullif(F.regexp_extract(F.regexp_extract(found, MEDIA, 1), r"\|([0-9]{1,9})$", 1), F.lit("")).cast("bigint"), F.lit(1).cast("bigint"))
        return F.struct(kind.alias("kind"), found.alias("text"), F.regexp_extract(found, MEDIA, 2).alias("ref"), units.alias("units"))

    # One list longer than the other: the last text has no media after it.
    pairs = F.arrays_zip(words.alias("w"), F.transform(F.regexp_extract_all(text, F.lit(MEDIA), 0), media).alias("m"))
    both = F.flatten(F.transform(pairs, lambda p: F.filter(F.array(p["w"], p["m"]), lambda x: x.isNotNull())))
    return F.when(F.instr(text, "![") > 0, both).otherwise(text_parts(text))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, attachments, expanded_tokens from rows of conv_id, turn, role and parts."""
    role = F.coalesce("role", F.lit(""))
    flat = turns.select("conv_id", "turn", role.alias("role"), flatten_parts(F.col("parts")).alias("flat"))
    mark = F.when(F.col("role") == TRAINED_ROLE, "[/INST]").otherwise("[INST]")
    piece = F.concat(F.lit("<s>"), escape(F.col("role")), mark, F.col("flat.content"), F.lit("</s>"))
    rows = flat.select("conv_id", "turn", "role", piece.alias("piece"), "flat.attachments")
    # Turns that are tied sort by role and content, within a chunk as between chunks.
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    chunks = rows.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "piece", "attachments"))).alias("list"))
    chunks = chunks.select("conv_id", "chunk", F.array_join(F.col("list.piece"), "").alias("piece"), F.flatten("list.attachments").alias("attachments"))
    joined = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "piece", "attachments"))).alias("list"))
    attachments = F.transform(F.flatten("list.attachments"), lambda a, i: F.struct(i.cast("long").alias("ordinal"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens"), a["source"].alias("source")))
    out = joined.select("conv_id", F.array_join(F.col("list.piece"), "").alias("formatted"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def restore(formatted: Column, attachments: Column) -> Column:
    """formatted with each placeholder replaced by the escaped text that it stood for. Placeholders in texts are escaped, so all that are found are ours."""
    stood = F.transform(attachments, lambda a: escape(a["source"]))
    return F.array_join(F.zip_with(F.split(formatted, _HOLDERS, -1), stood, lambda t, a: F.concat(t, F.coalesce(a, F.lit("")))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array<struct<role, text, trained>>; placeholders stay in the text as they are."""
    pieces = F.transform(F.array_remove(F.split(formatted, "</s>"), ""), lambda p: F.substr(p, F.lit(4)))

    def turn(p: Column) -> Column:
        plain, trained = F.instr(p, "[INST]"), F.instr(p, "[/INST]")
        loss = (trained > 0) & ((plain == 0) | (trained < plain))
        at = F.when(loss, trained).otherwise(plain)
        width = F.when(loss, F.lit(len("[/INST]"))).otherwise(F.lit(len("[INST]")))
        return F.struct(unescape(F.substr(p, F.lit(1), at - 1)).alias("role"), unescape(F.substr(p, at + width)).alias("text"), loss.alias("trained"))

    return F.transform(pieces, turn)


def sample_turns(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(text).alias("text")) for k, r in enumerate(("user", TRAINED_ROLE))])).alias("r")).select("r.*")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(sample_turns(spark))
    formatted = format_conversations(turns.select("conv_id", "turn", "role", typed_parts(F.col("text")).alias("parts")))
    read = formatted.withColumn("turns", parse(restore(F.col("formatted"), F.col("attachments"))))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: t["text"]), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
        F.sha2(F.array_join(F.transform("attachments", lambda a: F.concat(a["kind"], F.lit("\n"), a["ref"], F.lit("\n"))), "").cast("binary"), 256).alias("attachments_sha256"),
    )


def oracle() -> str:
    def escaped(x: str) -> str:
        out = f"replace({x}, '~', '~t')"
        for control, code in CODES:
            out = f"replace({out}, '{control}', '{code}')"
        return out

    quote = lambda x: "'" + x.replace("'", "''") + "'"
    kind = f"case when e in ({', '.join(map(quote, FILES['image']))}) then 'image' when e in ({', '.join(map(quote, FILES['audio']))}) then 'audio' else 'document' end"
    tokens = "case kind " + " ".join(f"when '{k}' then {fixed} + {each} * units" for k, (fixed, each) in EXPANSION.items()) + " end"
    return f"""
with c as (select row_number() over () rid, conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from (select conv_id, turn, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m0 as (select rid, x, i, regexp_extract(x, {quote(MEDIA)}, 1) alt, regexp_extract(x, {quote(MEDIA)}, 2) ref, regexp_extract(x, {quote(MEDIA)}, 3) e
  from (select rid, unnest(l) x, unnest(range(len(l))) i from (select rid, regexp_extract_all(t, {quote(MEDIA)}) l from c))),
m1 as (select rid, i, ref, {kind} kind, coalesce(try_cast(nullif(regexp_extract(alt, '\\|([0-9]{{1,9}})$', 1), '') as bigint), 1) units from m0),
m as (select rid, count(*) k, sum({tokens}) tokens, sum(length(kind) + 2) held, string_agg(kind || chr(10) || ref || chr(10), '' order by i) refs from m1 group by 1),
s as (select c.*, coalesce(k, 0) k, coalesce(tokens, 0) tokens, coalesce(held, 0) held, coalesce(refs, '') refs, regexp_replace(t, {quote(MEDIA)}, chr(1), 'g') seams from c left join m using (rid)),
f as (select *, length('<s>' || {escaped('r')} || case when r = 'assistant' then '[/INST]' else '[INST]' end || {escaped('seams')} || '</s>') - k + held n from s),
g as (select conv_id, count(*) n_turns, string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, r, t) a, coalesce(string_agg(t, '' order by turn nulls first, r, t) filter (r = 'assistant'), '') l, sum(n) n,
  sum(k) k, sum(tokens) tokens, string_agg(refs, '' order by turn nulls first, r, t) refs from f group by 1)
select conv_id, cast(n_turns as bigint) n_turns, sha256(a) turns_sha256, cast(length(l) as bigint) loss_chars, sha256(l) loss_sha256, cast(n as bigint) formatted_chars,
  cast(k as bigint) n_attachments, cast(tokens as bigint) expanded_tokens, sha256(refs) attachments_sha256 from g
"""


QUERIES = {"op4_chat_formatting": op4_chat_formatting}
ORACLES = {"op4_chat_formatting": oracle()}
