"""A training run: data-parallel steps, estimates on fixed draws, early stopping, the best weights kept, a log beside the output."""

from __future__ import annotations

import copy
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from turnloom.operators import checkpoints, network
from turnloom.operators.network import Adam, Network


def tee(path: str | None, out: Callable[[str], None] = print) -> Callable[[str], None]:
    """A function that says a line and, if there is a path (a file of the driver), writes it there at once."""
    if path is None:
        return out
    log = open(path, "w", encoding="utf-8")  # noqa: SIM115

    def say(line: str) -> None:
        out(line)
        log.write(line + "\n")
        log.flush()

    return say


def train(net: Network, train_windows: DataFrame, val_windows: DataFrame, symbols: list[str], steps: int, rate: Callable[[int], float], every: int = 10, patience: int = 0, checkpoint: str | None = None, log: str | None = None, select_by: str = "val", out: Callable[[str], None] = print) -> tuple[Network, list[dict]]:
    """The best network and the evaluations (step, train, val, gap, stale). Windows are (at, start, x, y) tables; each step reads the
    training windows once. A checkpoint is written whenever the chosen loss strictly improves; ``patience`` evaluations without that end the run."""
    say, adam, best, kept, stale, history = tee(log, out), Adam(net), None, net, 0, []
    began = time.time()
    for step in range(1, steps + 1):
        network.train_step(train_windows, net, adam, rate(step - 1))
        if step % every and step != steps:
            continue
        losses = {name: network.text_loss(w, net).first()["nats"] for name, w in (("train", train_windows), ("val", val_windows))}
        improved = best is None or losses[select_by] < best
        stale = 0 if improved else stale + 1
        if improved:
            best, kept = losses[select_by], copy.copy(net)
            kept.p = {k: v.copy() for k, v in net.p.items()}
            if checkpoint:
                checkpoints.save(train_windows.sparkSession, kept, symbols, checkpoint)
        history.append({"step": step, **losses, "gap": losses["val"] - losses["train"], "stale": stale, "seconds": time.time() - began})
        say(f"step {step} of {steps}: train {losses['train']:.4f}, val {losses['val']:.4f}, best {best:.4f}, {stale} without gain")
        if patience and stale >= patience:
            say("stopped early")
            break
    return kept, history
