"""Chat records of any known layout as canonical turns, formatted with reversible marks and a loss mask.

The layout of a JSON record is told by its schema fingerprint: the hash of its nested field paths. A registry maps
fingerprints to declarative mappings (where the turns are, or which fields are which turns). Only DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.store import free_names
from lectern.llm.textcols import let, running

#: Records above this size (bytes) don't fit a variant; they are read by the schemas of the registry.
VARIANT_BYTES = 100_000_000

TURNS = "array<struct<role:string,text:string>>"

# The strings that mean something to the template or to common models; none may appear inside a text.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>")


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: ``array`` of objects with ``role`` and ``text`` fields, or ``fields`` as (role, path) in order."""

    name: str
    example: str
    array: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()


#: The layouts that are known. ``example`` shows a record, from which the fingerprint is taken.
REGISTRY = (
    Mapping("messages", '{"messages":[{"role":"","content":""}]}', array="messages"),
    Mapping("conversations", '{"conversations":[{"from":"","value":""}]}', array="conversations", role="from", text="value", roles=(("human", "user"), ("gpt", "assistant"))),
    Mapping("dialog", '{"dialog":{"turns":[{"speaker":"","utterance":""}]}}', array="dialog.turns", role="speaker", text="utterance"),
    Mapping("prompt", '{"prompt":"","response":""}', fields=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt_completion", '{"prompt":"","completion":""}', fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", '{"instruction":"","output":""}', fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_system", '{"system":"","instruction":"","output":""}', fields=(("system", "system"), ("user", "instruction"), ("assistant", "output"))),
)


def field_paths(record: Column) -> Column:
    """The nested field names of a JSON record as one string, without value types and in order of name; null if it is no JSON object."""
    shape = F.schema_of_variant(F.try_parse_json(record))
    names = F.regexp_replace(shape, r": (?!OBJECT<|ARRAY<OBJECT<)(?:ARRAY<)*[A-Z0-9_(), ]+?>*(?=, [^,<>:]+: |>|$)", "")
    return F.when(shape.startswith("OBJECT<"), names)


def fingerprint(record: Column) -> Column:
    return F.sha2(field_paths(record), 256)


def _named(raw: Column, m: Mapping) -> Column:
    """Structs with the mapping's fields -> canonical turns."""

    def one(t: Column) -> Column:
        role = F.coalesce(t[m.role], F.lit(""))
        for name, canonical in m.roles:
            role = F.when(role == name, canonical).otherwise(role)
        return F.struct(role.alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text"))

    return F.transform(raw, one).cast(TURNS)


def _turns(v: Column, m: Mapping) -> Column:
    if m.array is None:
        turns = F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit("")).alias("text")) for role, path in m.fields])
        return turns.cast(TURNS)
    return _named(F.try_variant_get(v, f"$.{m.array}", f"array<struct<`{m.role}`:string,`{m.text}`:string>>"), m)


def _long_turns(record: Column, m: Mapping) -> Column:
    """The same from a record that is too long for a variant; null if its top-level fields are not the mapping's."""
    options = {"maxStringLen": str((1 << 31) - 1)}
    if m.array is None:
        fields = sorted(path for _, path in m.fields)
        parsed = F.from_json(record, ", ".join(f"`{f}` string" for f in fields), options)
        turns = let(parsed, lambda p: F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(p[path], F.lit("")).alias("text")) for role, path in m.fields]).cast(TURNS))
    else:
        fields, kind = [m.array.split(".")[0]], f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
        for step in reversed(m.array.split(".")):
            kind = f"struct<`{step}`:{kind}>"
        raw = F.from_json(record, kind, options)
        for step in m.array.split("."):
            raw = raw[step]
        turns = _named(raw, m)
    return F.when(F.array_sort(F.json_object_keys(record)) == F.array(*[F.lit(f) for f in fields]), turns)


def canonical_turns(records: DataFrame, record: str = "record", out: str = "turns", registry: tuple[Mapping, ...] = REGISTRY) -> DataFrame:
    """``records`` with ``out``, the canonical turns of the JSON in ``record``, and ``layout``, the name of its mapping.

    Null roles and texts are empty. Null records, records that are no JSON object, and layouts that the registry
    lacks have null turns and a null layout: they are kept and can be counted. Records of over ``VARIANT_BYTES`` are
    told by their top-level fields. Rows are independent, repeated ones give equal turns, an empty table stays empty;
    columns named ``layout`` and ``out`` are replaced, others pass unchanged whatever their names.
    """
    spark = records.sparkSession
    records = records.drop("layout", out)
    (mark,) = free_names(records, "fingerprint")
    known = spark.createDataFrame([(m.name, m.example) for m in registry], "layout string, example string").select("layout", fingerprint(F.col("example")).alias(mark))
    long = F.octet_length(record) > VARIANT_BYTES
    # one row for each mapping of the registry
    read = records.withColumn(mark, F.when(~long, fingerprint(F.col(record)))).join(F.broadcast(known), mark, "left")
    v = F.try_parse_json(F.col(record))
    turns, by_fields, name = F.lit(None).cast(TURNS), F.lit(None).cast(TURNS), F.col("layout")
    for m in registry:
        turns = F.when(F.col("layout") == m.name, _turns(v, m)).otherwise(turns)
        by_fields = F.coalesce(by_fields, _long_turns(F.col(record), m))
        name = F.coalesce(name, F.when(long & _long_turns(F.col(record), m).isNotNull(), m.name))
    return read.withColumns({out: F.when(long, by_fields).otherwise(turns), "layout": name}).select(*records.columns, out, "layout")


def _quoted(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in text)


#: A control string with any number of backslashes after its first character.
_ANY = "(?:" + "|".join(f"(?<={_quoted(c[0])})" + r"\\*" + _quoted(c[1:]) for c in CONTROL) + ")"


def escape(text: Column) -> Column:
    """One backslash goes after the first character of each control string, and of each one that already has backslashes there."""
    return F.regexp_replace(text, f"({_ANY})", r"\\$1")


def unescape(text: Column) -> Column:
    one_less = "(?:" + "|".join(f"(?<={_quoted(c[0])})" + r"\\(\\*" + _quoted(c[1:]) + ")" for c in CONTROL) + ")"
    return F.regexp_replace(text, one_less, "".join(f"${i + 1}" for i in range(len(CONTROL))))


def _escape_role(role: Column) -> Column:
    """A role ends at the first line feed, so its own are written as backslash and n, its backslashes as backslash and s."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    """A backslash is followed by s or n, so that neither replacement meets the other's."""
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _piece(role: Column, text: Column, trained: str) -> Column:
    """A turn as mark, role, line feed, text, end mark, with its head's length and whether its text is under the loss mask."""
    head = F.concat(F.lit(TURN), _escape_role(F.coalesce(role, F.lit(""))), F.lit("\n"))
    return let(head, lambda h: F.struct(F.concat(h, escape(F.coalesce(text, F.lit(""))), F.lit(END)).alias("piece"), F.length(h).alias("head"), F.coalesce(role == trained, F.lit(False)).alias("loss")))


def format_turns(turns: DataFrame, role: str = "role", text: str = "text", trained: str = "assistant") -> DataFrame:
    """A row for each turn -> the same rows with ``piece``, its formatted text, and ``loss_start``, ``loss_end``, the span of it that is under the loss mask (null: none).

    The pieces of a conversation in order are its formatted text. Null roles and texts are empty. Rows are
    independent, however many a conversation has; columns of the three names are replaced, others pass unchanged.
    """
    turns = turns.drop("piece", "loss_start", "loss_end")
    (made,) = free_names(turns, "made")
    done = turns.withColumn(made, _piece(F.col(role), F.col(text), trained))
    span = {"loss_start": F.col(made)["head"], "loss_end": F.length(F.col(made)["piece"]) - len(END)}
    return done.select(*turns.columns, F.col(made)["piece"].alias("piece"), *[F.when(F.col(made)["loss"], c).alias(n) for n, c in span.items()])


def format_chat(chats: DataFrame, turns: str = "turns", trained: str = "assistant") -> DataFrame:
    """``chats``, a conversation in a row, with ``formatted`` and ``loss_spans`` (start, end in code points of the texts of ``trained`` turns, as escaped).

    Null or no turns give an empty string without spans; null roles and texts are empty. Rows are independent, an
    empty table stays empty; columns of the two names are replaced, others pass unchanged. A conversation has to fit
    a row: longer ones are formatted by ``format_turns``.
    """
    chats = chats.drop("formatted", "loss_spans")
    (made,) = free_names(chats, "made")
    pieces = F.transform(F.coalesce(F.col(turns), F.array().cast(TURNS)), lambda t: _piece(t["role"], t["text"], trained))

    def spans(p: Column) -> Column:
        before = running(F.transform(p, lambda x: F.length(x["piece"]).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
        each = F.zip_with(p, before, lambda x, at: F.struct(x["loss"].alias("loss"), F.struct((at + x["head"]).alias("start"), (at + F.length(x["piece"]) - len(END)).alias("end")).alias("span")))
        return F.transform(F.filter(each, lambda e: e["loss"]), lambda e: e["span"])

    none = F.array().cast("array<struct<start:long,end:long>>")
    done = chats.withColumn(made, pieces)
    return done.select(*chats.columns, F.array_join(F.transform(made, lambda x: x["piece"]), "").alias("formatted"), F.when(F.size(made) > 0, spans(F.col(made))).otherwise(none).alias("loss_spans"))


def _read_piece(p: Column) -> Column:
    """A piece without its end mark -> role and text."""
    cut = F.instr(p, "\n")
    return F.struct(_unescape_role(F.substring(p, F.lit(len(TURN) + 1), cut - len(TURN) - 1)).alias("role"), unescape(F.substring(p, cut + 1, F.length(p))).alias("text"))


def read_turn(piece: Column) -> Column:
    """The role and text of a formatted turn."""
    return _read_piece(F.substring(piece, F.lit(1), F.length(piece) - len(END)))


def loss_text(piece: Column, start: Column, end: Column) -> Column:
    """The text of a formatted turn under the loss mask, unescaped; empty where there is none."""
    return F.coalesce(unescape(F.substring(piece, (start + 1).cast("int"), (end - start).cast("int"))), F.lit(""))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted chat."""
    return F.transform(F.filter(F.split(formatted, _quoted(END), -1), lambda p: p != ""), _read_piece).cast(TURNS)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
