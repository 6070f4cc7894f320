"""Chat formatting by a finite-state machine over roles and a declarative template, in DataFrame functions only.

The template names the marks of a turn, the roles' labels, which roles the loss covers, and which role may follow which.
Inside texts the control strings and the escape character are escaped, so that they occur in the output only as marks:
backslash becomes \\e, ### becomes \\h, </turn> becomes \\t; in labels of undeclared roles a colon becomes \\c too.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    head: str = "### "
    colon: str = ": "
    end: str = "</turn>\n"
    #: Longest first; each stays unambiguous after the escapes before it.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\e"), ("###", "\\h"), ("</turn>", "\\t"))
    label_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    loss: tuple[str, ...] = ("assistant",)
    #: Roles that may follow each state; a conversation ends well in a state of final.
    next: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, mark in pairs:
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescape(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for plain, mark in reversed(pairs):
        text = F.replace(text, F.lit(mark), F.lit(plain))
    return text


def _label(role: Column, t: Template) -> Column:
    out = F.concat(F.lit("~"), escape(role, t.escapes + t.label_escapes))
    for name, label in t.labels.items():
        out = F.when(role == name, F.lit(label)).otherwise(out)
    return out


def _role(label: Column, t: Template) -> Column:
    out = unescape(F.substr(label, F.lit(2)), t.escapes + t.label_escapes)
    for name, shown in t.labels.items():
        out = F.when(label == shown, F.lit(name)).otherwise(out)
    return out


def format_chats(conversations: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """One row for each conv_id of conversations (conv_id, turn long, role, text string; other columns are ignored).

    conv_id, n_turns long, valid boolean (the roles are a path of the template's machine from its start to a final state),
    error_turn long (place, from 0, of the first turn that breaks the order; null if none), segments array of (text, loss):
    three a turn, whose texts joined are the formatted conversation.

    Null texts and roles count as empty; undeclared roles get an escaped label and are never valid. Turns are ordered by
    turn (null first), repeated turns by role and text; repeated rows are turns of their own. A row without conv_id
    is a conversation of its own. A conversation's output is one row, so it must fit a task; formatting and escaping come before grouping.
    """
    t = template
    role = F.coalesce(F.col("role"), F.lit(""))
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"), role.alias("role"), F.concat(F.lit(t.head), _label(role, t), F.lit(t.colon)).alias("head"), escape(F.coalesce(F.col("text"), F.lit("")), t.escapes).alias("body")
        ).alias("t"),
    )
    chats = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    chats = chats.unionByName(turns.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    allowed = F.array(*[F.lit(f"{state}>{role}") for state, roles in t.next.items() for role in roles])
    start = F.struct(F.lit("").alias("state"), F.lit(0).cast("long").alias("at"), F.lit(-1).cast("long").alias("error"))

    def step(s: Column, x: Column) -> Column:
        bad = ~F.array_contains(allowed, F.concat(s["state"], F.lit(">"), x["role"]))
        return F.struct(x["role"].alias("state"), (s["at"] + 1).alias("at"), F.when((s["error"] < 0) & bad, s["at"]).otherwise(s["error"]).alias("error"))

    run = chats.withColumn("run", F.aggregate("turns", start, step))

    def parts(x: Column) -> Column:
        return F.array(
            F.struct(x["head"].alias("text"), F.lit(False).alias("loss")), F.struct(x["body"].alias("text"), x["role"].isin(*t.loss).alias("loss")), F.struct(F.lit(t.end).alias("text"), F.lit(False).alias("loss"))
        )

    return run.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        ((F.col("run.error") < 0) & F.col("run.state").isin(*t.final)).alias("valid"),
        F.when(F.col("run.error") >= 0, F.col("run.error")).alias("error_turn"),
        F.flatten(F.transform("turns", parts)).alias("segments"),
    )


def formatted(segments: Column | str) -> Column:
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_turns(text: Column, template: Template = TEMPLATE) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    t = template
    blocks = F.split(text, F.lit("\\Q" + t.end + "\\E"), -1)

    def turn(block: Column) -> Column:
        body = F.substr(block, F.lit(len(t.head) + 1))
        label = F.substring_index(body, t.colon, 1)
        return F.struct(_role(label, t).alias("role"), unescape(F.substr(body, F.length(label) + len(t.colon) + 1), t.escapes).alias("text"))

    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn)


def read_loss_text(segments: Column | str, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template.escapes)), "")
