"""Chat formatting with DataFrame functions only: a role automaton, a declarative template, segments with loss flags."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import table

#: Moves of the role automaton: state and role to the next state. What is missing is a fault.
TURN_ORDER = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
    ("assistant", "tool"): "tool",
    ("tool", "tool"): "tool",
    ("tool", "assistant"): "assistant",
}


@dataclass(frozen=True)
class Template:
    """How turns are written: `open` role `close` text `end`, and on which roles' texts there is a loss.

    Control strings inside texts lose their first character to an escape code,
    and the escape character itself is doubled up the same way, so that no
    control string is left in a text and each text can be had back.
    """

    open: str = "<|im_start|>"
    close: str = "\n"
    end: str = "<|im_end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: TURN_ORDER)

    def escape(self, text: Column) -> Column:
        text = F.replace(text, F.lit("\\"), F.lit("\\b"))
        for first, code in (("<", "\\\\l"), ("[", "\\\\s")):
            rest = "|".join("\\Q" + c[1:] + "\\E" for c in self.control if c[0] == first)
            text = F.regexp_replace(text, f"\\{first}(?={rest})", code)
        return text

    def unescape(self, text: Column) -> Column:
        for code, first in (("\\l", "<"), ("\\s", "["), ("\\n", "\n"), ("\\b", "\\")):
            text = F.replace(text, F.lit(code), F.lit(first))
        return text

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("\\n"))


def format_chats(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """A row for each conv_id of turns (conv_id, turn, role, text): segments (text, loss), formatted, valid, fault_at.

    Turns go by turn (null first), then role and text, so repeated and tied
    rows have a fixed order; null roles and texts are empty strings; rows with
    a null conv_id are one conversation. valid says whether the automaton
    accepts the roles and the conversation ends with an assistant turn;
    fault_at is the index of the first turn that it rejects, else null.
    Conversations are formatted whether valid or not.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\0{role}", to)])
    steps = F.aggregate(
        "turns",
        F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault")),
        lambda a, t: F.struct(
            F.coalesce(F.element_at(moves, F.concat(a["state"], F.lit("\0"), t["role"])), F.lit("fault")).alias("state"),
            (a["at"] + 1).alias("at"),
            F.coalesce(a["fault"], F.when(~F.map_contains_key(moves, F.concat(a["state"], F.lit("\0"), t["role"])), a["at"])).alias("fault"),
        ),
    )

    def segments(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(template.open), template.escape_role(t["role"]), F.lit(template.close))
        return F.array(segment(head, F.lit(False)), segment(template.escape(t["text"]), t["role"].isin(*template.loss_roles)), segment(F.lit(template.end), F.lit(False)))

    made = chats.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), steps.alias("steps"))
    return made.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), (F.col("steps.fault").isNull() & (F.col("steps.state") == "assistant")).alias("valid"), F.col("steps.fault").alias("fault_at"))


def read_chats(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation holds."""
    parts = F.filter(F.split(formatted, "\\Q" + template.open + "\\E"), lambda p: p != "")

    def turn(part: Column) -> Column:
        body = F.substring(part, F.lit(1), F.length(part) - len(template.end))
        role = F.substring_index(body, template.close, 1)
        return F.struct(template.unescape(role).alias("role"), template.unescape(F.substring(body, F.length(role) + len(template.close) + 1, F.length(body))).alias("text"))

    return F.transform(parts, turn)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    template = Template()
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    chats = format_chats(turns.unionByName(added), template).withColumn("back", read_chats(F.col("formatted"), template))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid").select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid"
    )
