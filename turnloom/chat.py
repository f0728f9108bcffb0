"""A chat in a terminal with a checkpoint: python -m turnloom.chat CHECKPOINT [HISTORY_FOLDER]."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.functions.markers import END
from turnloom.operators import checkpoints, corpus
from turnloom.sources import texts


def chat(spark: SparkSession, checkpoint: str, read: Callable[[], str | None], say: Callable[[str], None], history: str | None = None, new: int = 200) -> None:
    """Reads lines until none or an empty one comes; answers each behind the last turns that fit the model; keeps both sides in ``history``."""
    net, symbols = checkpoints.load(spark, checkpoint)
    at, turns = {c: i for i, c in enumerate(symbols)}, []
    while line := read():
        turns.append((len(turns), "user", line))
        table = corpus.turns(spark.createDataFrame([(0, *t) for t in turns], "conv_id long, turn long, role string, text string"))
        prompt = corpus.prompt_windows(table, net.config.block_size).first()["prompt"]
        ids = net.generate([at[c] for c in prompt if c in at], new, at.get(END))
        raw = spark.createDataFrame([("".join(symbols[i] for i in ids),)], "raw string")
        working, reply = T.displayed(T.clean_response(F.col("raw")))
        shown = raw.select(working.alias("working"), reply.alias("reply")).first()
        if shown["working"]:
            say(f"({shown['working']})")
        say(shown["reply"])
        turns.append((len(turns), "assistant", shown["reply"]))
        if history:
            texts.add_history(spark.createDataFrame([t[1:] for t in turns[-2:]], "role string, text string"), history)


if __name__ == "__main__":
    from turnloom.session import local_session

    chat(local_session(app="chat"), sys.argv[1], lambda: input("> "), print, *sys.argv[2:3])
