"""Chat formatting in budgeted windows (operator 9): DataFrame functions only.

A turn is written as ``<s>role newline text</s>``, or with ``<r>`` where it repeats an
earlier turn as context. Control strings inside roles and texts are escaped with a backslash
after their first character, backslashes are doubled, so the output can be read back.

Prefix sums of turn tokens cut a conversation into turn-aligned windows: what BUDGET leaves
beside the system turn is halved, and a window holds the new turns that start in one half's
length of the prefix sums. A turn longer than such a half has a window of its own, which a
prefix count of such turns marks. So a window keeps to the budget unless it is one turn that
alone, beside the system turn, is longer. Each later window opens with the system turn, if the conversation
starts with one, and with up to HISTORY turns before its first new turn, of these the nearest
ones that the budget still has room for. The loss mask holds the texts of new assistant turns;
repeated ones are masked out.

* Null text or role: empty. Turns that share a number are ordered by role and text.
* Null conversation ids form one conversation. Empty table: empty result. Repeated rows are
  turns of their own. Extra columns are ignored.
* One conversation ends in one row, as its digest needs it; its windows are built apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 512
HISTORY = 2
OPEN, REPEATED, CLOSE = "<s>", "<r>", "</s>"
#: Fixed control strings; a newline is one inside a role.
CONTROL = [OPEN, REPEATED, CLOSE, "[INST]", "[/INST]"]


def escape(text: Column, strings: list[str] = CONTROL) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for x in strings:
        text = F.replace(text, F.lit(x), F.lit(f"{x[0]}\\{x[1:]}"))
    return text


def unescape(text: Column, strings: list[str] = CONTROL) -> Column:
    for x in strings:
        text = F.replace(text, F.lit(f"{x[0]}\\{x[1:]}"), F.lit(x))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n>"), F.lit("\n")))


def n_tokens(text: Column) -> Column:
    """Tokens of a turn for the budget: one for each four characters begun, and one for the turn."""
    return F.floor((F.length(text) + 3) / 4).cast("long") + 1


def spans(turns: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Adds to each turn of (conv_id, turn, role, text) its position ``i``, window ``w``, tokens before it, and the system turn's tokens."""
    whole = Window.partitionBy("conv_id")
    conv = whole.orderBy("turn", "role", "text")
    placed = turns.withColumns(
        {
            "i": F.row_number().over(conv) - 1,
            "n": n_tokens(F.col("text")),
            "before": F.coalesce(F.sum(n_tokens(F.col("text"))).over(conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    system = F.max(F.when((F.col("i") == 0) & (F.col("role") == "system"), F.col("n"))).over(whole)
    half = F.greatest(F.lit(1), F.floor((budget - F.col("n_system")) / 2))
    cut = placed.withColumn("n_system", F.coalesce(system, F.lit(0))).withColumn("cut", F.floor(F.col("before") / half).cast("long"))
    long = (F.col("n") > half).cast("int")
    alone = F.coalesce(F.sum(long).over(conv.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 2 + long
    cut = cut.withColumn("alone", alone)
    return cut.withColumn("w", F.dense_rank().over(whole.orderBy("cut", "alone")) - 1).drop("cut", "alone")


def shown(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per turn and window that shows it; ``new`` where it is not repeated."""
    whole = Window.partitionBy("conv_id")
    conv = whole.orderBy("i")
    sized = turns.withColumns({"n_new": F.sum("n").over(Window.partitionBy("conv_id", "w")), "last_w": F.max("w").over(whole)})
    later = []
    for j in range(1, history + 1):
        first = F.lead(F.struct("w", "before", "n_new"), j).over(conv)  # the turn j places on, where a window begins with it
        last = F.lead("w", j - 1).over(conv) if j > 1 else F.col("w")
        fits = F.col("n_system") + first["before"] - F.col("before") + first["n_new"] <= budget
        later.append(F.when((first["w"] != last) & fits, first["w"]))
    all_w = sized.withColumn("later", F.array(*later))
    repeats = F.when(
        (F.col("i") == 0) & (F.col("role") == "system") & (F.col("last_w") > 0), F.sequence(F.lit(1), "last_w")
    ).otherwise(F.filter("later", lambda x: x.isNotNull() & (x > F.col("w"))))
    at = F.concat(F.array(F.col("w")), F.array_distinct(repeats))
    return all_w.select("conv_id", "i", "n", "role", "text", F.col("w").alias("home"), F.explode(at).alias("w")).withColumn(
        "new", F.col("w") == F.col("home")
    )


def format_windows(turns: DataFrame, *, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Per window: conv_id, w, formatted, and ``loss``: starts and lengths of unmasked characters."""
    clean = turns.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    lines = shown(spans(clean, budget), budget, history).select(
        "conv_id",
        "w",
        "i",
        (F.col("new") & (F.col("role") == "assistant")).alias("target"),
        F.concat(F.when(F.col("new"), OPEN).otherwise(REPEATED), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        escape(F.col("text")).alias("body"),
    )
    size = F.length("head") + F.length("body") + len(CLOSE)
    window = Window.partitionBy("conv_id", "w").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("start", F.coalesce(F.sum(size).over(window), F.lit(0)) + F.length("head"))
    span = F.struct("i", F.col("start").alias("start"), F.length("body").alias("length"))
    return (
        placed.groupBy("conv_id", "w")
        .agg(
            F.sort_array(F.collect_list(F.struct("i", F.concat("head", "body", F.lit(CLOSE)).alias("line")))).alias("l"),
            F.sort_array(F.collect_list(F.when(F.col("target"), span))).alias("loss"),
        )
        .select(
            "conv_id",
            "w",
            F.array_join(F.transform("l", lambda x: x["line"]), "").alias("formatted"),
            F.transform("loss", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss"),
        )
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from formatted windows alone: turns, unmasked text, and formatted size."""
    parts = F.filter(F.split("formatted", CLOSE, -1), lambda x: x.startswith(OPEN))
    turns = F.transform(
        parts,
        lambda x: F.struct(
            unescape_role(F.substring_index(F.substring(x, F.lit(len(OPEN) + 1), F.length(x)), "\n", 1)).alias("role"),
            unescape(F.substring(x, F.locate("\n", x) + 1, F.length(x))).alias("text"),
        ),
    )
    loss = F.transform(
        "loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))
    )
    each = windows.select("conv_id", "w", turns.alias("turns"), loss.alias("loss"), F.length("formatted").alias("size"))
    return (
        each.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("w", "turns", "loss"))).alias("ws"), F.sum("size").alias("formatted_chars"))
        .select(
            "conv_id",
            F.flatten(F.transform("ws", lambda x: x["turns"])).alias("turns"),
            F.array_join(F.flatten(F.transform("ws", lambda x: x["loss"])), "").alias("loss_text"),
            F.col("formatted_chars").cast("long").alias("formatted_chars"),
        )
    )


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
