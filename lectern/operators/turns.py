"""Conversations: validation, bounded history, and context that is carried from turn to turn."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import ranges as R
from lectern.functions import text as X
from lectern.functions import values as V
from lectern.sources.store import bounded, cut

MESSAGES, MESSAGE_CHARS, TOTAL_CHARS = 20, 4000, 33_333


def validate_history(turns: DataFrame, messages: int = MESSAGES, chars: int = MESSAGE_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """FLT6: ``conv_id, violation``: roles alternate from user to assistant, texts neither blank nor too long, not too many, not too much in all."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("_before", F.lag("role").over(w))
    per = rows.groupBy("conv_id").agg(
        F.count("*").alias("n"),
        F.min_by("role", "turn").alias("first"),
        F.max_by("role", "turn").alias("last"),
        F.bool_or(F.coalesce(F.col("role") == F.col("_before"), F.lit(False))).alias("repeated"),
        F.bool_or(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"),
        F.max(F.length("text")).alias("longest"),
        F.sum(F.length("text")).alias("total"),
    )
    rules = (("roles_repeat", F.col("repeated")), ("first_not_user", F.col("first") != "user"), ("last_not_assistant", F.col("last") != "assistant"), ("blank_message", F.col("blank")), ("message_too_long", F.col("longest") > chars), ("too_many_messages", F.col("n") > messages), ("history_too_long", F.col("total") > total))
    return per.select("conv_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))).alias("violation"))


def validate_actions(actions: DataFrame, codes: list[str], topics: list[str], most: int = 3) -> DataFrame:
    """FLT7: ``query_id, violation`` of ``actions(query_id, action_idx, status, type, codes, topics, subject_text, concepts)``."""
    none = F.array().cast("array<string>")
    c, t = F.coalesce("codes", none), F.coalesce("topics", none)
    subject = F.coalesce(F.trim("subject_text"), F.lit("")) != ""
    groups = F.coalesce("concepts", F.array().cast("array<array<string>>"))
    rules = (
        ("contact_with_subject", (F.col("type") == "contact") & (subject | (F.size(t) > 0) | (F.size(groups) > 0))),
        ("subject_missing", F.col("type").isin("information", "comparison") & ~subject & (F.size(t) == 0)),
        ("comparison_needs_two", (F.col("type") == "comparison") & (F.size(F.array_distinct(c)) < 2)),
        ("unknown_code", F.size(F.array_except(c, F.array(*[F.lit(x) for x in codes]))) > 0),
        ("unknown_topic", F.size(F.array_except(t, F.array(*[F.lit(x) for x in topics]))) > 0),
        ("unknown_type", ~F.col("type").isin("information", "comparison", "contact")),
        ("empty_concept", F.exists(groups, lambda g: F.size(F.filter(g, lambda x: F.trim(x) != "")) == 0)),
        ("clarification_with_action", F.col("status") == "clarify"),
    )
    each = actions.select("query_id", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules]))).alias("violation"))
    many = actions.groupBy("query_id").count().where(F.col("count") > most).select("query_id", F.lit("too_many_actions").alias("violation"))
    twice = actions.groupBy("query_id", "type", F.array_sort(F.array_distinct(c)).alias("k")).count().where("count > 1").select("query_id", F.lit("repeated_action").alias("violation"))
    return each.unionByName(many).unionByName(twice).distinct()


def question_pairs(turns: DataFrame) -> DataFrame:
    """Complete pairs: a user turn and the assistant turn right after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumns({"_role": F.lead("role").over(w), "answer": F.lead("text").over(w)})
    return rows.where("role = 'user' and _role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"), "answer")


def bounded_history(turns: DataFrame, question_chars: int = 2000, answer_chars: int = 3000, total: int = TOTAL_CHARS, messages: int = MESSAGES) -> DataFrame:
    """RNK17: the newest pairs, clipped, until one would exceed the total or there are enough: ``conv_id, turn, question, answer``."""
    pairs = question_pairs(turns).withColumns({"question": F.substring("question", 1, question_chars), "answer": F.substring("answer", 1, answer_chars)})
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    pairs = pairs.withColumns({"n": F.row_number().over(w), "chars": F.sum(F.length("question") + F.length("answer")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return pairs.where((F.col("n") <= messages // 2) & (F.col("chars") <= total)).select("conv_id", "turn", "question", "answer")


def recent_questions(turns: DataFrame, n: int = 3) -> DataFrame:
    """RNK18: for each user turn the last ``n`` non-blank user texts before it, newest first."""
    users = turns.where((F.col("role") == "user") & (F.trim("text") != ""))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return users.select("conv_id", "turn", F.reverse(F.collect_list("text").over(w)).alias("recent"))


def same_subject(text: Column, codes: Column, names: Column) -> Column:
    """STR7: one entity, and the rest asks for the same subject."""
    from lectern.operators.detect import _strip_names

    rest = F.trim(F.regexp_replace(F.lower(X.unaccent(_strip_names(text, names))), "[^a-z0-9]+", " "))
    return (F.size(codes) == 1) & X.any_pattern(rest, V.SAME_SUBJECT_PATTERNS)


# ---- STR4: context that is carried over ----------------------------------------------------------------------------

STATE = "struct<types:array<string>,codes:array<array<string>>,subject:string>"
CARRY_COLUMNS, CARRY_STRINGS = ["conv_id", "turn", "resolution", "type", "codes", "subject", "reason"], ("resolution", "type", "codes", "subject", "reason")
TURN_OUT = "conv_id long, turn long, resolution string, type string, codes array<string>, subject string, reason string"


def next_step(state: tuple[list[str], list[list[str]], str | None], turn: dict) -> tuple[tuple, dict]:
    """One turn of carry-over: the state that replaces ``state``, and the resolved action.

    ``state`` holds the types and codes of the last actions and their subject; ``turn`` the operation (``continue``,
    ``replace_country``, ``add_country``, ``select_action``, ``ambiguous`` or none), codes, subject and type. A
    comparison needs two codes or the turn passes through unchanged; an inherited subject that is empty asks for a
    topic; several prior actions are chosen from by an explicit single match of type, else a choice is asked for.
    """
    types, codes, subject = state
    own, op = list(dict.fromkeys(turn["codes"] or [])), turn["operation"]
    asked = {"type": turn["type"], "codes": own, "subject": turn["subject"]}

    def done(resolution: str, reason: str | None = None, **change) -> tuple[tuple, dict]:
        out = asked | change | {"resolution": resolution, "reason": reason}
        if reason:
            return ([], [], None), out
        keep = bool(out["codes"])
        return ([out["type"]] if keep else [], [out["codes"]] if keep else [], out["subject"] if keep else None), out

    if op == "ambiguous":
        return done("clarify", "ambiguous")
    if op not in ("continue", "replace_country", "add_country", "select_action") or not types:
        return done("pass")
    if len(types) > 1:
        match = [i for i, t in enumerate(types) if t == turn["type"]]
        if len(match) != 1:
            return done("clarify", "select_action")
        chosen = match[0]
    else:
        chosen = 0
    kind, before = types[chosen], codes[chosen]
    if op == "replace_country":
        now = own or before
    elif op == "add_country":
        now = list(dict.fromkeys([*before, *own]))
    else:
        now = before
    if kind == "comparison" and len(now) < 2:
        return done("pass")
    if kind == "information" and op == "add_country" and len(now) >= 2:
        kind = "comparison"
    text = turn["subject"] or subject
    if kind != "contact" and not (text or "").strip():
        return done("clarify", "missing_topic")
    return done("carried", type=kind, codes=now, subject=None if kind == "contact" else text)


# Marks that stand for what a segment of turns does not know yet: the codes before it, one or several, their subject and kind.
_ONE, _MANY, _SUBJECT, _KIND = "\0one", "\0many", "\0subject", "\0kind"
_KINDS = ("information", "comparison", "contact", _KIND)


def segment_function(turns: list[dict]) -> dict:
    """What a run of turns makes of any state before it: ``only``, the first code that is added alone, and a state for each case.

    Turns look at a state's kind, at whether it has one code or several, or just the code that they add, and at whether
    its subject is blank. So the steps are taken from a state of marks for each such case; the marks left in the end are
    filled in from the real state. Cases that have come together, as all do at a turn that does not carry over, are
    taken on as one.
    """
    only = next((list(dict.fromkeys(t["codes"]))[0] for t in turns if t["operation"] == "add_country" and len(set(t["codes"] or [])) == 1), None)
    starts: dict[str, tuple] = {"": ([], [], None)}
    for kind in _KINDS:
        for name, codes in (("one", [_ONE]), ("many", [_MANY + "1", _MANY + "2"]), ("only", [only])):
            for subject in (None, _SUBJECT):
                if name != "only" or only is not None:
                    starts[f"{kind}|{name}|{'blank' if subject is None else 'text'}"] = ([kind], [codes], subject)
    names, states = list(starts), list(starts.values())
    at = dict(zip(names, range(len(names)), strict=True))
    for t in turns:
        states = [next_step(s, t)[0] for s in states]
        place: dict[str, int] = {}
        moved = [place.setdefault(json.dumps(s), len(place)) for s in states]
        at = {n: moved[i] for n, i in at.items()}
        states = [json.loads(s) for s in place]
    return {"only": only, "cases": at, "states": states}


def applied(function: dict, state: tuple) -> tuple[list[str], list[list[str]], str | None]:
    """The state after a segment of turns."""
    types, codes, subject = state
    if not types:
        case = ""
    else:
        own = "many" if len(codes[0]) > 1 else "only" if function["only"] is not None and codes[0] == [function["only"]] else "one"
        case = f"{types[0] if types[0] in _KINDS else _KIND}|{own}|{'text' if (subject or '').strip() else 'blank'}"
    kinds, lists, text = function["states"][function["cases"][case]]
    filled = []
    for one in lists:
        whole = [c for x in one for c in (codes[0] if x in (_ONE, _MANY + "1") else [] if x == _MANY + "2" else [x])]
        filled.append(list(dict.fromkeys(whole)))
    return [types[0] if k == _KIND else k for k in kinds], filled, subject if text == _SUBJECT else text


def _turn(row: dict) -> dict:
    return {"codes": row["codes"], "operation": row["operation"], "type": row["type"], "subject": row["subject"]}


_TURN_ORDER = ["who", "turn", "operation", "type", "subject"]


def carry_context(turns: DataFrame, range_rows: int = R.RANGE_ROWS) -> DataFrame:
    """STR4 and STR5 over a table: ``turns(conv_id, turn, operation, type, codes, subject)`` -> resolved turns.

    Turns are sorted into ranges over all tasks, so a conversation of any length is spread over them: each range gives a
    conversation's turns in it as one function of the state before them, the functions of a conversation are applied
    one after the other, a row for each range, and each range then takes its steps from the state it begins with.
    Turns of one number go by operation, type and subject; a null ``conv_id`` is a conversation of its own.
    """
    rows = R.sorted_ranges(turns.select(R.key_of("conv_id").alias("who"), "conv_id", "turn", "operation", "type", "codes", "subject"), _TURN_ORDER, range_rows)
    spread = R.spread_keys(rows, "who")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in R.tables(batches):
            begin, out = R.begins(table.column("who")), []
            for a, b in zip(begin[:-1], begin[1:], strict=True):
                piece = table.slice(a, b - a)
                out.append((piece.column("who")[0].as_py(), piece.column("part")[0].as_py(), json.dumps(segment_function([_turn(r) for r in piece.to_pylist()]))))
            who, part, function = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.string()), pa.array(part, pa.int32()), pa.array(function, pa.string())], ["who", "part", "function"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, state = None, ([], [], None)
        for batch in batches:
            states = []
            for row in batch.to_pylist():
                if row["who"] != who:
                    who, state = row["who"], ([], [], None)
                states.append(json.dumps(state))
                state = applied(json.loads(row["function"]), state)
            yield pa.RecordBatch.from_arrays([batch.column("who"), batch.column("part"), pa.array(states, pa.string())], ["who", "part", "state"])

    functions = cut(R.in_order(rows.join(spread, "who", "left_semi"), _TURN_ORDER).mapInArrow(summed, "who string, part int, function string"), "functions")
    # a row for each range that a long conversation lies in
    before = cut(functions.repartition("who").sortWithinPartitions("who", "part").mapInArrow(prefixes, "who string, part int, state string"), "states")

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, ([], [], None)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if key != (row["part"], row["who"]):
                    key = (row["part"], row["who"])
                    state = json.loads(row["state"]) if row["state"] else ([], [], None)
                state, got = next_step(state, _turn(row))
                out.append({"conv_id": row["conv_id"], "turn": row["turn"], **{c: got[c] for c in CARRY_COLUMNS[2:]}})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("resolution", pa.string()), ("type", pa.string()), ("codes", pa.list_(pa.string())), ("subject", pa.string()), ("reason", pa.string())]))

    told = R.in_order(rows.join(bounded(before), ["who", "part"], "left"), _TURN_ORDER)
    return told.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")}).mapInArrow(steps, TURN_OUT)


def last_context(turns: DataFrame) -> DataFrame:
    """STR4 for single actions, in SQL: each turn with its own codes and subject, or else the last ones before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    codes = F.when(F.size("codes") > 0, F.col("codes"))
    subject = F.when(F.trim("subject") != "", F.col("subject"))
    return turns.withColumns({"context_codes": F.last(codes, ignorenulls=True).over(w), "context_subject": F.last(subject, ignorenulls=True).over(w)})


def next_state(executed: DataFrame) -> DataFrame:
    """STR5: ``executed(query_id, action_idx, type, codes, available, clarification)`` -> ``query_id, actions, focus, ordered_codes, pending``.

    Actions without an available code go; the focus is set if exactly one is left; a clarification leaves only itself.
    """
    kept = executed.withColumn("_c", F.array_intersect("codes", "available"))
    per = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when((F.size("_c") > 0) & F.col("clarification").isNull(), F.struct("action_idx", "type", F.col("_c").alias("codes"))))).alias("a"), F.max("clarification").alias("pending"))
    actions = F.transform("a", lambda x: F.struct(x["type"].alias("type"), x["codes"].alias("codes")))
    rows = per.withColumn("actions", F.when(F.col("pending").isNull(), actions).otherwise(F.array().cast("array<struct<type:string,codes:array<string>>>")))
    compared = F.flatten(F.transform(F.filter("actions", lambda x: x["type"] == "comparison"), lambda x: x["codes"]))
    return rows.select("query_id", "actions", F.when(F.size("actions") == 1, 0).alias("focus"), F.array_distinct(compared).alias("ordered_codes"), "pending")


def local_followup(turns: DataFrame, previous: DataFrame) -> DataFrame:
    """STR6: entity-only turns after exactly one action become its ``replace_country`` (a comparison needs two codes).

    ``turns(conv_id, turn, only_codes)``, ``previous(conv_id, turn, types, subject)``: the state before each turn.
    """
    rows = turns.where("only_codes is not null").join(previous.where("size(types) = 1"), ["conv_id", "turn"])
    kind = F.get("types", F.lit(0))
    return rows.where((kind != "comparison") | (F.size("only_codes") >= 2)).select("conv_id", "turn", F.lit("replace_country").alias("operation"), kind.alias("type"), F.col("only_codes").alias("codes"), "subject")
