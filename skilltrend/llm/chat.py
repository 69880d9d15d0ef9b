"""Chat formatting of unlike layouts, with built-in functions only.

A layout is recognised by the hash of the nested field paths that it needs, and
each row's fields go to those it fills, as a table may hold several; each
known layout has a declarative mapping to canonical turns (``conv_id``, ``turn``,
``role``, ``text``). Turns are written with control strings around them. Control
strings inside texts are escaped: a run ``<``, tildes, ``|`` gets one tilde more,
so what a text says never marks a turn and reading takes the tilde away again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def field_paths(kind: T.DataType, above: str = "") -> list[str]:
    """All nested field paths in order, ``[]`` standing for the elements of a list."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{above}.{f.name}" if above else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{above}[]")
    return [above]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _listed(messages: str, role: str, text: str) -> Callable[[DataFrame], DataFrame]:
    """Turns of a list of messages, in its order."""

    def turns(df: DataFrame) -> DataFrame:
        each = df.select("conv_id", F.posexplode(messages).alias("turn", "message"))
        return each.select("conv_id", "turn", F.col(f"message.{role}").alias("role"), F.col(f"message.{text}").alias("text"))

    return turns


def _fixed(*turns: tuple[str, Column]) -> Callable[[DataFrame], DataFrame]:
    """One turn for each pair of a role and an expression; null expressions make none."""

    def make(df: DataFrame) -> DataFrame:
        parts = F.array(*(F.struct(F.lit(k).alias("turn"), F.lit(role).alias("role"), text.alias("text")) for k, (role, text) in enumerate(turns)))
        each = df.select("conv_id", F.explode(parts).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")
        return each.where(F.col("text").isNotNull())

    return make


@dataclass(frozen=True)
class Layout:
    name: str
    paths: tuple[str, ...]
    turns: Callable[[DataFrame], DataFrame]
    #: Role names that the layout uses for the canonical ones.
    roles: tuple[tuple[str, str], ...] = ()

    def filled(self, df: DataFrame) -> dict[str, Column]:
        """For each column but the id, whether a row has something there."""
        names = dict.fromkeys(path.split(".")[0].removesuffix("[]") for path in self.paths if path != "conv_id")
        lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
        return {n: F.coalesce(F.size(n) > 0, F.lit(False)) if n in lists else F.col(n).isNotNull() for n in names}


#: Role names that other layouts use for the canonical ones.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def layouts() -> list[Layout]:
    """The known layouts, those with more fields first."""
    asked = F.concat_ws("\n\n", F.nullif(F.col("instruction"), F.lit("")), F.nullif(F.col("input"), F.lit("")))
    asked = F.when(F.col("instruction").isNotNull() | F.col("input").isNotNull(), asked)
    known = [
        Layout("turn rows", ("conv_id", "turn", "role", "text"), lambda df: df.select("conv_id", "turn", "role", "text")),
        Layout("messages", ("conv_id", "messages[].role", "messages[].content"), _listed("messages", "role", "content"), tuple(ROLES.items())),
        Layout("conversations", ("conv_id", "conversations[].from", "conversations[].value"), _listed("conversations", "from", "value"), tuple(ROLES.items())),
        Layout("instruction, input", ("conv_id", "instruction", "input", "output"), _fixed(("user", asked), ("assistant", F.col("output")))),
        Layout("instruction", ("conv_id", "instruction", "output"), _fixed(("user", F.col("instruction")), ("assistant", F.col("output")))),
        Layout("system, prompt", ("conv_id", "system", "prompt", "response"), _fixed(("system", F.col("system")), ("user", F.col("prompt")), ("assistant", F.col("response")))),
        Layout("prompt, response", ("conv_id", "prompt", "response"), _fixed(("user", F.col("prompt")), ("assistant", F.col("response")))),
        Layout("prompt, completion", ("conv_id", "prompt", "completion"), _fixed(("user", F.col("prompt")), ("assistant", F.col("completion")))),
    ]
    return sorted(known, key=lambda layout: -len(layout.paths))


def canonical_turns(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` of a table in any known layouts.

    A layout is there if the fingerprint of those of the table's field paths that
    it names is its own; further fields are ignored. Each filled field of a row
    goes to one of the layouts there that name it: to one that the row fills
    wholly before one that it fills in part, then to the one with most filled and
    fewest other fields. So a row that fills two layouts gives the turns of both,
    the better one's first, and no text is given twice or lost. A row that fills
    no field of any, empty lists included, gives one turn without number, role
    and text, so no row disappears. ``roles`` maps role names of all layouts; by default lists of
    messages get ``ROLES`` and others keep their names. With no known layout it raises.
    """
    paths = field_paths(df.schema)
    there = [x for x in layouts() if fingerprint([p for p in paths if p in x.paths]) == fingerprint(list(x.paths))]
    if not there:
        raise ValueError(f"no known layout among the fields {paths}")

    def canonical(turns: DataFrame, names: dict[str, str]) -> DataFrame:
        role = F.col("role").cast("string")
        for other, ours in names.items():
            role = F.when(F.col("role") == other, F.lit(ours)).otherwise(role)
        return turns.select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(role, F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        )

    def named(layout: Layout) -> dict[str, str]:
        return dict(layout.roles) if roles is None else roles

    if [layout.name for layout in there] == ["turn rows"]:
        return canonical(there[0].turns(df), named(there[0]))
    scores, owners = [], {}
    for k, layout in enumerate(there):
        filled = layout.filled(df)
        number, whole = F.lit(0), F.lit(True)
        for own in filled.values():
            number, whole = number + own.cast("int"), whole & own
        scores.append(F.when(number > 0, whole.cast("int") * 10_000 + number * 100 + k).otherwise(F.lit(0)))
        for name, own in filled.items():
            owners.setdefault(name, []).append((k, own))

    def most(parts: list[Column]) -> Column:
        return F.greatest(*parts) if len(parts) > 1 else parts[0]

    # For each layout, its columns and whether they go to it.
    taken = []
    for k, layout in enumerate(there):
        best = {name: most([scores[j] for j, _ in owners[name]]) for name in layout.filled(df)}
        taken.append({name: own & (scores[k] == best[name]) for name, own in layout.filled(df).items()})
    used = [reduce(Column.__or__, own.values()) for own in taken]
    empty = df.where(most(scores) == 0).select("conv_id", *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("role", "string"), ("text", "string"))))
    out = canonical(empty, {})
    for k, layout in enumerate(there):
        # Turns of a row's second layout come after those of its first.
        ahead = reduce(Column.__add__, ((some & (score > scores[k])).cast("long") for score, some in zip(scores, used)))
        own = df.where(used[k]).withColumns(
            {
                **{name: F.when(column, F.col(name)) for name, column in taken[k].items()},
                "conv_id": F.struct(F.col("conv_id").alias("id"), (ahead * F.lit(1 << 32)).alias("ahead")),
            }
        )
        turns = layout.turns(own)
        turns = turns.withColumns({"turn": F.col("turn").cast("long") + F.col("conv_id.ahead"), "conv_id": F.col("conv_id.id")})
        out = out.union(canonical(turns, named(layout)))
    return out


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", r"<$1~|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)~\|", r"<$1|")


def formatted_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss`` (list of ``start`` and ``length``).

    Turns are ordered by number, then role and text; rows that repeat are turns
    of their own, and a null conversation is one. Starts and lengths count code
    points of ``formatted`` and mark the texts of ``trained`` roles.
    """
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    rows = turns.withColumn("head", head).withColumn("body", escaped(F.col("text")))
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(f"{END}\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.when(
        F.col("role").isin(*trained),
        F.struct((F.col("end") - F.length("piece") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length")),
    )
    whole = rows.withColumn("span", span).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("place", "piece", "span"))).alias("all")
    )
    return whole.select(
        "conv_id",
        F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("all", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (list of ``role`` and ``text``), ``trained`` (texts under the mask) and ``formatted`` of written chats."""
    pieces = F.split(F.col("formatted"), f"\\Q{END}\n\\E")
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        line = F.instr(piece, "\n")
        role = F.substr(piece, F.lit(len(START) + 1), line - 1 - len(START))
        return F.struct(
            unescaped(F.replace(role, F.lit(LINE), F.lit("\n"))).alias("role"), unescaped(F.substr(piece, line + 1)).alias("text")
        )

    masked = F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), masked.alias("trained"), "formatted")


def chat_digests(read: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns``, ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars`` of what was read."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("trained", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
