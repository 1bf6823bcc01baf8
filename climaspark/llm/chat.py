"""Chat formatting: a record's nested field paths, hashed, choose the mapping that turns it into canonical turns; a reversible template; a loss mask."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """A layout by its field paths, as `a`, `a.b` or `a[].b`, and how its turns are read: a JSON path of the list and of role and text in it,
    or, for flat layouts, (role, field) pairs in order, of which those that are null or absent give no turn."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    listed: tuple[str, str, str] | None = None


MAPPINGS = (
    Mapping("turn", ("role", "text", "turn"), listed=("", "role", "text")),
    Mapping("messages", ("messages", "messages[].content", "messages[].role"), listed=("messages", "role", "content")),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), listed=("conversations", "from", "value")),
    Mapping("prompt-response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Mapping("prompt-completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("system-prompt-response", ("prompt", "response", "system"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction-input", ("input", "instruction", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
)
# Names that the layout `conversations` has for the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Parser's options: strings of any length, and an error where a record doesn't parse, instead of nulls.
WHOLE = {"mode": "FAILFAST", "maxStringLen": "2147483647"}


def _printed(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> int | None:
        try:
            return hashed(tuple(paths_of(json.loads(text))))
        except (TypeError, ValueError):
            return None

    return pd.Series([one(t) for t in texts], dtype="Int64")


def paths_of(record: object, at: str = "") -> set[str]:
    """The field paths of a parsed JSON record; array steps are []."""
    if isinstance(record, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in record))
    if not isinstance(record, dict):
        return set()
    here = {k: f"{at}.{k}" if at else k for k in record}
    return set(here.values()).union(*(paths_of(v, here[k]) for k, v in record.items()))


def hashed(paths: tuple[str, ...]) -> int:
    return crc32("\n".join(sorted(paths)).encode())


def fingerprint(record: str | Column) -> Column:
    """CRC-32 of the sorted distinct field paths of a JSON record, array steps as []; key order, values and list lengths don't count. Null: malformed."""
    return F.pandas_udf(_printed, "long")(F.col(record) if isinstance(record, str) else record)


def _turn_of(role: str, text: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(x[role].alias("role"), x[text].alias("text"))


def canonical(records: DataFrame, key: str = "conv_id", record: str = "record", order: str | None = None, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(key, order, place, layout, role, text) of JSON records of mixed layouts, a row for each turn. Texts may have any length.

    `order` names a column that orders records of one key. An unknown layout or malformed record gives one row with null
    layout, role and text, so that nothing goes unseen; a known one without turns gives none; one that cannot be parsed raises. Only the layout `conversations` has other names for roles.
    """
    record_, roles = F.col(record), F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    turn = "array<struct<role:string,text:string>>"
    one = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    layout, turns = F.lit(None).cast("string"), one.cast(turn)
    for m in mappings:
        if m.listed and m.listed[0]:
            at, role, text = m.listed
            parsed = F.from_json(record_, f"`{at}` array<struct<`{role}`:string,`{text}`:string>>", WHOLE)[at]
            found = F.transform(parsed, _turn_of(role, text))
        elif m.listed:
            parsed = F.from_json(record_, f"`{m.listed[1]}` string, `{m.listed[2]}` string", WHOLE)
            found = F.array(F.struct(parsed[m.listed[1]].alias("role"), parsed[m.listed[2]].alias("text")))
        else:
            parsed = F.from_json(record_, ", ".join(f"`{f}` string" for _, f in m.turns), WHOLE)
            found = F.filter(F.array(*(F.struct(F.lit(r).alias("role"), parsed[f].alias("text")) for r, f in m.turns)), lambda x: x["text"].isNotNull())
        chosen = F.col("_print") == F.lit(hashed(m.paths))
        layout, turns = F.when(chosen, F.lit(m.name)).otherwise(layout), F.when(chosen, found.cast(turn)).otherwise(turns)
    rows = records.select(F.col(key).alias("_key"), (F.col(order) if order else F.lit(0)).cast("long").alias("_order"), record, fingerprint(record).alias("_print"))
    rows = rows.select("_key", "_order", layout.alias("layout"), F.posexplode(turns).alias("place", "turn"))
    role = F.col("turn.role")
    role = F.when(F.col("layout") == "conversations", F.coalesce(roles[role], role)).otherwise(role)
    return rows.select(F.col("_key").alias(key), F.col("_order").alias("order"), "place", "layout", role.alias("role"), F.col("turn.text").alias("text"))


# The template: a turn is [INST role] text [/INST], an assistant's <s> text </s>; a backslash stands before every [, < and \ of a role or text.
OPEN, CLOSE = {"assistant": "<s>"}, {"assistant": "</s>"}
OTHER_OPEN, ROLE_END, OTHER_CLOSE = "[INST ", "]", "[/INST]"


def escaped(column: Column) -> Column:
    return F.regexp_replace(column, r"([\\\[\]<])", r"\\$1")


def formatted(turns: DataFrame) -> DataFrame:
    """turns with `segment`, the turn in the template; a conversation's text is its segments in order. Null roles and texts are empty."""
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    said = F.concat(F.lit(OPEN["assistant"]), text, F.lit(CLOSE["assistant"]))
    other = F.concat(F.lit(OTHER_OPEN), escaped(role), F.lit(ROLE_END), text, F.lit(OTHER_CLOSE))
    return turns.withColumn("segment", F.when(role == "assistant", said).otherwise(other))


def read_segments(text: str) -> list[tuple[str, str, bool]]:
    """(role, text, under the loss mask) of each turn of a formatted conversation: the template's inverse."""
    out, i = [], 0

    def until(stop: str) -> str:
        nonlocal i
        piece, slash, end = [], -1, -1
        while True:
            # Places that are found stay until they are passed, so that a text of many escapes is read once.
            slash = slash if slash >= i else text.find("\\", i) % (len(text) + 1)
            end = end if end >= i else text.find(stop, i) % (len(text) + 1)
            at = min(slash, end)
            if at == len(text):
                raise ValueError("the text ends within a turn")
            piece.append(text[i:at])
            if at == end:
                i = at + len(stop)
                return "".join(piece)
            piece.append(text[at + 1])
            i = at + 2

    while i < len(text):
        if text.startswith(OPEN["assistant"], i):
            i += len(OPEN["assistant"])
            out.append(("assistant", until(CLOSE["assistant"]), True))
        elif text.startswith(OTHER_OPEN, i):
            i += len(OTHER_OPEN)
            role = until(ROLE_END)
            out.append((role, until(OTHER_CLOSE), False))
        else:
            raise ValueError("no turn begins here")
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments come in order; a conversation is hashed as it passes and never held."""
    now, n, chars, size = None, 0, 0, 0
    whole, loss = hashlib.sha256(), hashlib.sha256()
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    began = False
    for pdf in batches:
        out = []
        for conv, segment in zip(pdf["conv_id"].tolist(), pdf["segment"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if not began or conv != now:
                if began:
                    out.append((now, n, whole.hexdigest(), chars, loss.hexdigest(), size))
                now, n, chars, size, began = conv, 0, 0, 0, True
                whole, loss = hashlib.sha256(), hashlib.sha256()
            size += len(segment)
            for role, text, under in read_segments(segment):
                n += 1
                whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if under:
                    chars += len(text)
                    loss.update(text.encode("utf-8", "surrogatepass"))
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64"})
    if began:
        yield pd.DataFrame([(now, n, whole.hexdigest(), chars, loss.hexdigest(), size)], columns=names).astype({"conv_id": "Int64"})


def digests(segments: DataFrame) -> DataFrame:
    """Read back from (conv_id, order, place, segment): a row for each conversation. A long conversation streams through one task, as its digest must."""
    width = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments.select(F.col("conv_id").cast("long").alias("conv_id"), "order", "place", "segment").repartition(width, "conv_id").sortWithinPartitions("conv_id", "order", "place", "segment")
    return ordered.mapInPandas(_digests, DIGESTS)


def records_of(conversations: DataFrame) -> DataFrame:
    """Rows by turn as JSON records of the layout `turn`; null texts and roles are empty."""
    return conversations.select("conv_id", "turn", F.to_json(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"))).alias("record"))


#: Conversations of more turns stay rows by turn where layouts are mixed: a record of the others holds a whole conversation.
MOST_TURNS = 500


def mixed_records(conversations: DataFrame) -> DataFrame:
    """Conversations as records (conv_id, turn, record) of six layouts, chosen by conv_id, number of turns and roles.

    Those of one user's and one assistant's turn are prompts with responses or completions, or instructions; others lists of messages,
    of `from` and `value` where the roles are those of that layout, or records by turn. Null texts and roles are empty.
    """
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.col("role").isin("system", "user", "assistant", "tool")).alias("plain"), F.min_by("role", "turn").alias("first"), F.max_by("role", "turn").alias("last"))
    pick = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(3))
    pair = (F.col("n") == 2) & (F.col("first") == "user") & (F.col("last") == "assistant")
    layout = F.when(F.col("n") > MOST_TURNS, "turn").when(pair, F.array(F.lit("prompt-response"), F.lit("instruction"), F.lit("prompt-completion"))[pick.cast("int")])
    layout = layout.when(pick == 0, "messages").when((pick == 1) & F.col("plain"), "conversations").otherwise("turn")
    told = rows.withColumnRenamed("conv_id", "id").join(sizes.select("conv_id", layout.alias("layout")), F.col("id").eqNullSafe(F.col("conv_id")))
    by_turn = told.where("layout = 'turn'").select("conv_id", "turn", F.to_json(F.struct("role", "text", "turn")).alias("record"))
    whole = told.where("layout != 'turn'").groupBy("conv_id", "layout").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    t = F.col("t")
    back = {v: k for k, v in ROLES.items() if k in ("human", "gpt")}
    theirs = F.create_map(*(F.lit(x) for kv in back.items() for x in kv))
    record = F.when(F.col("layout") == "messages", F.to_json(F.struct(F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"))))
    record = record.when(F.col("layout") == "conversations", F.to_json(F.struct(F.transform(t, lambda x: F.struct(F.coalesce(theirs[x["role"]], x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"))))
    for name, ask, say in (("prompt-response", "prompt", "response"), ("prompt-completion", "prompt", "completion"), ("instruction", "instruction", "output")):
        record = record.when(F.col("layout") == name, F.to_json(F.struct(t[0]["text"].alias(ask), t[1]["text"].alias(say))))
    return by_turn.unionByName(whole.select("conv_id", F.lit(0).cast("long").alias("turn"), record.alias("record")))
