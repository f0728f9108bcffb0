"""A small decoder-only transformer in numpy: forward, loss, generation with a cache, and training steps.

The model is a few megabytes of parameters that every task reads whole; rows (windows, prompts) are what
grows, and they are scored in Arrow batches wherever they lie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.operators.weights import parameter_shapes
from turnloom.session import small, spread, staged

IGNORE = -100
# Coefficients of a rational approximation of the error function, within 1.5e-7 (Abramowitz and Stegun 7.1.26).
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _erf(x):
    size = np.abs(x)
    t = 1 / (1 + 0.3275911 * size)
    sum_ = np.full_like(t, ERF[-1])
    for c in reversed(ERF[:-1]):
        sum_ = sum_ * t + c
    return np.sign(x) * (1 - sum_ * t * np.exp(-size * size))


@dataclass(frozen=True)
class Config:
    vocab_size: int
    block_size: int
    n_layer: int
    n_head: int
    n_embd: int


def initial(config: Config, seed: int) -> dict[str, np.ndarray]:
    """Weights N(0, 0.02), gains one, biases zero."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape in parameter_shapes(config.vocab_size, config.n_layer, config.n_embd, config.block_size):
        if len(shape) == 2:
            out[name] = rng.normal(0, 0.02, shape)
        else:
            out[name] = np.ones(shape) if ".ln" in name and name.endswith("weight") or name == "ln_f.weight" else np.zeros(shape)
    return out


def _norm(x, gain, bias):
    mean = np.full((x.shape[-1], 1), 1 / x.shape[-1], x.dtype)  # a product is faster than a mean over few numbers
    z = x - x @ mean
    spread = 1 / np.sqrt((z * z) @ mean + 1e-5)
    z *= spread
    out = z * gain
    out += bias
    return out, (z, spread)


def _norm_back(d, gain, kept):
    z, spread = kept
    g = d * gain
    dx = spread * (g - g.mean(-1, keepdims=True) - z * (g * z).mean(-1, keepdims=True))
    axes = tuple(range(d.ndim - 1))
    return dx, (d * z).sum(axes), d.sum(axes)


def gelu(x):
    """The exact form, by the error function (as _erf, in few passes over the memory: x sign(x) is the size of x)."""
    size = np.abs(x)
    t = size * (0.3275911 * math.sqrt(0.5))
    t += 1
    np.reciprocal(t, out=t)
    sum_ = t * ERF[-1]
    for c in reversed(ERF[1:-1]):
        sum_ += c
        sum_ *= t
    sum_ += ERF[0]
    sum_ *= t
    np.multiply(size, size, out=t)
    t *= -0.5
    sum_ *= np.exp(t, out=t)
    np.subtract(1, sum_, out=sum_)
    sum_ *= size
    sum_ += x
    sum_ *= 0.5
    return sum_


def softmax(x, out=None):
    """out: may be x itself."""
    e = np.subtract(x, x.max(-1, keepdims=True), out=out)
    np.exp(e, out=e)
    e /= e @ np.ones((e.shape[-1], 1), e.dtype)  # a product is faster than a sum over few numbers
    return e


def _affine(x, weight, bias):
    out = x @ weight.T
    out += bias
    return out


class Network:
    """kind: double precision for training and references, single for scoring."""

    def __init__(self, config: Config, params: dict[str, np.ndarray], kind: type = np.float64):
        self.config, self.p = config, {k: np.asarray(v, kind) for k, v in params.items()}

    def forward(self, ids: np.ndarray, keep: list | None = None, last: bool = False) -> np.ndarray:
        """Logits (batch, time, vocabulary) of id windows no longer than the block. keep: gets what backward() needs. last: only those of the last place."""
        c, p = self.config, self.p
        n, t = ids.shape
        heads, size = c.n_head, c.n_embd // c.n_head
        x = p["tok_emb.weight"][ids] + p["pos_emb.weight"][:t]
        mask = np.triu(np.full((t, t), -np.inf, x.dtype), 1)
        for i in range(c.n_layer):
            b = f"blocks.{i}."
            h, k1 = _norm(x, p[b + "ln1.weight"], p[b + "ln1.bias"])
            qkv = _affine(h, p[b + "attn.qkv.weight"], p[b + "attn.qkv.bias"])
            q, k, v = (a.reshape(n, t, heads, size).transpose(0, 2, 1, 3) for a in np.split(qkv, 3, -1))
            if last and i == c.n_layer - 1:
                q, x, mask = q[:, :, -1:], x[:, -1:], mask[-1:]
            w = (q * q.dtype.type(1 / math.sqrt(size))) @ k.transpose(0, 1, 3, 2)
            w += mask
            softmax(w, w)
            y = (w @ v).transpose(0, 2, 1, 3).reshape(n, -1, c.n_embd)
            x += _affine(y, p[b + "attn.proj.weight"], p[b + "attn.proj.bias"])
            m, k2 = _norm(x, p[b + "ln2.weight"], p[b + "ln2.bias"])
            f = _affine(m, p[b + "mlp.fc.weight"], p[b + "mlp.fc.bias"])
            g = gelu(f)
            x += _affine(g, p[b + "mlp.proj.weight"], p[b + "mlp.proj.bias"])
            if keep is not None:
                keep.append((h, k1, q, k, v, w, y, m, k2, f, g))
        out, kf = _norm(x, p["ln_f.weight"], p["ln_f.bias"])
        if keep is not None:
            keep.append((out, kf))
        return out @ p["tok_emb.weight"].T

    def losses(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Mean cross entropy of each window over its targets that aren't IGNORE."""
        z = self.forward(x)
        z -= z.max(-1, keepdims=True)
        use = y != IGNORE
        hit = np.take_along_axis(z, np.where(use, y, 0)[..., None], -1)[..., 0]
        np.exp(z, out=z)
        lse = np.log(z @ np.ones(z.shape[-1], z.dtype))
        return np.where(use, lse - hit, 0).sum(1) / np.maximum(1, use.sum(1))

    def gradients(self, ids: np.ndarray, targets: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all targets that aren't IGNORE, and its gradient by parameter."""
        c, p, keep = self.config, self.p, []
        z = self.forward(ids, keep)
        n, t = ids.shape
        heads, size = c.n_head, c.n_embd // c.n_head
        use = targets != IGNORE
        count = max(1, int(use.sum()))
        probability = softmax(z)
        at = np.where(use, targets, 0)[..., None]
        loss = float((-np.log(np.take_along_axis(probability, at, -1))[..., 0] * use).sum() / count)
        dz = probability
        np.put_along_axis(dz, at, np.take_along_axis(dz, at, -1) - 1, -1)
        dz *= use[..., None] / count
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g = {k: np.zeros_like(v) for k, v in p.items()}
        out, kf = keep.pop()
        g["tok_emb.weight"] += flat(dz).T @ flat(out)
        dx, g["ln_f.weight"], g["ln_f.bias"] = _norm_back(dz @ p["tok_emb.weight"], p["ln_f.weight"], kf)
        for i in reversed(range(c.n_layer)):
            b = f"blocks.{i}."
            h, k1, q, k, v, w, y, m, k2, f, act = keep.pop()
            g[b + "mlp.proj.weight"], g[b + "mlp.proj.bias"] = flat(dx).T @ flat(act), flat(dx).sum(0)
            df = (dx @ p[b + "mlp.proj.weight"]) * (0.5 * (1 + _erf(f * math.sqrt(0.5))) + f * np.exp(-f * f / 2) / math.sqrt(2 * math.pi))
            g[b + "mlp.fc.weight"], g[b + "mlp.fc.bias"] = flat(df).T @ flat(m), flat(df).sum(0)
            d, g[b + "ln2.weight"], g[b + "ln2.bias"] = _norm_back(df @ p[b + "mlp.fc.weight"], p[b + "ln2.weight"], k2)
            dx = dx + d
            g[b + "attn.proj.weight"], g[b + "attn.proj.bias"] = flat(dx).T @ flat(y), flat(dx).sum(0)
            dy = (dx @ p[b + "attn.proj.weight"]).reshape(n, t, heads, size).transpose(0, 2, 1, 3)
            dw = dy @ v.transpose(0, 1, 3, 2)
            ds = w * (dw - (dw * w).sum(-1, keepdims=True)) / math.sqrt(size)
            parts = [(a.transpose(0, 2, 1, 3).reshape(n, t, c.n_embd)) for a in (ds @ k, ds.transpose(0, 1, 3, 2) @ q, w.transpose(0, 1, 3, 2) @ dy)]
            dqkv = np.concatenate(parts, -1)
            g[b + "attn.qkv.weight"], g[b + "attn.qkv.bias"] = flat(dqkv).T @ flat(h), flat(dqkv).sum(0)
            d, g[b + "ln1.weight"], g[b + "ln1.bias"] = _norm_back(dqkv @ p[b + "attn.qkv.weight"], p[b + "ln1.weight"], k1)
            dx = dx + d
        np.add.at(g["tok_emb.weight"], ids, dx)
        g["pos_emb.weight"][:t] += dx.sum(0)
        return loss, g

    def generate(self, prompt: list[int], new: int, stop: int | None = None, temperature: float = 0.0, top_k: int | None = None, seed: int = 0) -> list[int]:
        """New ids after a prompt; temperature 0 takes the first largest logit. Windows slide over the last block."""
        rng = np.random.default_rng(seed)
        ids, cache = list(prompt), Cache(self)
        for _ in range(new):
            z = cache.next(ids)
            if temperature <= 0:
                at = int(np.argmax(z))
            else:
                z = z / max(temperature, 1e-6)
                if top_k and top_k < len(z):
                    z = np.where(z >= np.partition(z, -top_k)[-top_k], z, -np.inf)
                at = int(min(np.searchsorted(np.cumsum(softmax(z)), rng.random()), len(z) - 1))
            ids.append(at)
            if at == stop:
                break
        return ids[len(prompt):]


    def continued(self, prompts: list[list[int]], new: int, stop: int | None = None, size: int = 16) -> list[list[int]]:
        """generate() at temperature 0 of many prompts, ``size`` windows of one length at a time."""
        block, out, going = self.config.block_size, [[] for _ in prompts], range(len(prompts))
        tails = [list(p[-block:]) for p in prompts]
        for _ in range(new):
            by_length: dict[int, list[int]] = {}
            for i in going:
                by_length.setdefault(len(tails[i]), []).append(i)
            for length, of in by_length.items():
                for low in range(0, len(of), size):
                    part = of[low : low + size]
                    # Without any id there are no logits, and generate() takes the first id.
                    best = self.forward(np.array([tails[i] for i in part]), last=True)[:, -1].argmax(-1).tolist() if length else [0] * len(part)
                    for i, at in zip(part, best):
                        out[i].append(at)
                        tails[i] = [*tails[i], at][-block:]
            going = [i for i in going if out[i][-1] != stop]
        return out


class Cache:
    """Keys and values of the ids fed so far. When the window slides, positions change and it is filled anew."""

    def __init__(self, net: Network):
        self.net, self.seen = net, []
        self.clear()

    def clear(self) -> None:
        c = self.net.config
        self.k = [np.zeros((c.block_size, c.n_head, c.n_embd // c.n_head)) for _ in range(c.n_layer)]
        self.v = [np.zeros_like(a) for a in self.k]
        self.seen = []

    def next(self, ids: list[int]) -> np.ndarray:
        """Logits after ids, of which the last block counts."""
        window = list(ids[-self.net.config.block_size:])
        if self.seen != window[: len(self.seen)] or len(self.seen) == len(window):
            self.clear()
        z = None
        for i in window[len(self.seen):]:
            z = self.step(i)
        return z

    def step(self, token: int) -> np.ndarray:
        c, p, at = self.net.config, self.net.p, len(self.seen)
        heads, size = c.n_head, c.n_embd // c.n_head
        x = p["tok_emb.weight"][token] + p["pos_emb.weight"][at]
        for i in range(c.n_layer):
            b = f"blocks.{i}."
            h, _ = _norm(x, p[b + "ln1.weight"], p[b + "ln1.bias"])
            q, self.k[i][at], self.v[i][at] = (a.reshape(heads, size) for a in np.split(p[b + "attn.qkv.weight"] @ h + p[b + "attn.qkv.bias"], 3))
            w = softmax(np.einsum("hd,thd->ht", q, self.k[i][: at + 1]) / math.sqrt(size))
            x = x + p[b + "attn.proj.weight"] @ np.einsum("ht,thd->hd", w, self.v[i][: at + 1]).ravel() + p[b + "attn.proj.bias"]
            m, _ = _norm(x, p[b + "ln2.weight"], p[b + "ln2.bias"])
            x = x + p[b + "mlp.proj.weight"] @ gelu(p[b + "mlp.fc.weight"] @ m + p[b + "mlp.fc.bias"]) + p[b + "mlp.proj.bias"]
        self.seen.append(token)
        return p["tok_emb.weight"] @ _norm(x, p["ln_f.weight"], p["ln_f.bias"])[0]


class Adam:
    """AdamW: betas 0.9 and 0.99, decay on matrices only, gradients clipped to a total norm of one."""

    def __init__(self, net: Network, decay: float = 0.01, clip: float = 1.0):
        self.net, self.decay, self.clip, self.t = net, decay, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in net.p.items()}
        self.s = {k: np.zeros_like(v) for k, v in net.p.items()}

    def step(self, gradients: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        norm = math.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        scale = min(1.0, self.clip / (norm + 1e-6))
        for k, g in gradients.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.s[k] = 0.99 * self.s[k] + 0.01 * g * g
            if self.net.p[k].ndim >= 2:
                self.net.p[k] *= 1 - rate * self.decay
            self.net.p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.s[k] / (1 - 0.99**self.t)) + 1e-8)


def train_step(windows: DataFrame, net: Network, optimizer: Adam, rate: float) -> float:
    """One data-parallel step: gradients are summed where the windows lie and one sum a partition comes back."""
    spark = windows.sparkSession
    shipped = spark.sparkContext.broadcast((net.config, net.p))
    names = list(net.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        config, params = shipped.value
        model, total, count, loss = Network(config, params), None, 0, 0.0
        for pdf in batches:
            if len(pdf):
                x, y = np.stack(pdf["x"].to_list()).astype(int), np.stack(pdf["y"].to_list()).astype(int)
                part, g = model.gradients(x, y)
                n = int((y != IGNORE).sum())
                loss, count = loss + part * n, count + n
                total = {k: (0 if total is None else total[k]) + g[k] * n for k in names}
        if count:
            yield pd.DataFrame({"n": [count], "loss": [loss], "g": [np.concatenate([total[k].ravel() for k in names])]})

    rows = windows.select("x", "y").mapInPandas(run, "n long, loss double, g array<double>").collect()  # a row a partition
    n = sum(r["n"] for r in rows)
    if not n:
        return float("nan")
    flat, at, gradients = sum(np.array(r["g"]) for r in rows) / n, 0, {}
    for k in names:
        size = net.p[k].size
        gradients[k], at = flat[at : at + size].reshape(net.p[k].shape), at + size
    optimizer.step(gradients, rate)
    return sum(r["loss"] for r in rows) / n


def window_losses(windows: DataFrame, net: Network, key: str, size: int = 16) -> DataFrame:
    """key, start, loss (nats) of each (x, y) window, scored in single precision, ``size`` at a time.

    Windows are small rows made of few large ones, so they are dealt out by number before they are scored."""
    spark = windows.sparkSession
    shipped = spark.sparkContext.broadcast((net.config, net.p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Network(*shipped.value, np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                x, y = (part.column(i).flatten().to_numpy().reshape(part.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.losses(x, y), pa.float64())], [key, "start", "loss"])

    rows = windows.select(F.col(key).cast("long").alias(key), F.col("start").cast("long").alias("start"), "x", "y").where(F.size("x") == F.size("y"))
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts).mapInArrow(run, f"{key} long, start long, loss double")


def text_loss(windows: DataFrame, net: Network) -> DataFrame:
    """One row: windows, nats (the mean of the windows' means; NaN without any) and bits a character."""
    scored = window_losses(windows, net, "at")
    nats = F.coalesce(F.avg("loss"), F.lit(float("nan")))
    return scored.agg(F.count("*").alias("windows"), nats.alias("nats")).withColumn("bits", F.col("nats") / math.log(2))


def generated(prompts: DataFrame, net: Network, key: str, new: int, stop: int | None = None, temperature: float = 0.0, **how) -> DataFrame:
    """key, ids: what the model adds to each prompt (key, ids); draws depend on the key alone.

    Without draws, only a prompt's last block of ids counts: each different one is continued once, many at a time."""
    shipped = prompts.sparkSession.sparkContext.broadcast((net.config, net.p))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Network(*shipped.value)
        for pdf in batches:
            ids = [model.generate([int(i) for i in p], new, stop, temperature, seed=int(k), **how) for k, p in zip(pdf[key], pdf["ids"])]
            yield pd.DataFrame({key: pdf[key], "ids": ids})

    def greedy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Network(*shipped.value)
        for pdf in batches:
            yield pd.DataFrame({"tail": pdf["tail"], "added": model.continued([[int(i) for i in p] for p in pdf["tail"]], new, stop)})

    if temperature > 0:
        return spread(prompts.select(key, "ids")).mapInPandas(run, f"{key} long, ids array<int>")
    n = F.size("ids")
    held = spread(prompts.select(key, "ids")).select(F.col(key).cast("long").alias(key), F.slice("ids", F.greatest(n - net.config.block_size, F.lit(0)) + 1, net.config.block_size).alias("tail"))
    told = staged(held.select("tail").distinct().mapInPandas(greedy, "tail array<int>, added array<int>"), "continued")
    return held.join(small(told), "tail").select(key, F.col("added").alias("ids"))
