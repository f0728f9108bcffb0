"""Weights as rows: grouped quantization, packing, base85, half floats, and vector operators.

Column functions throughout.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import base85 as functions_base85

LEAST_SCALE = 1e-6


def half(x: Column) -> Column:
    """A non-negative double rounded to the nearest half float, ties to even."""
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.greatest(x, F.lit(1e-300)))), F.lit(-14)) - 10)
    return F.rint(x / step) * step


def half_of_bits(bits: Column) -> Column:
    """The double of a half float's 16 bits: sign, 5 of exponent, 10 of fraction; subnormals, infinities and NaN included."""
    sign = F.when(F.shiftright(bits, 15) == 1, -1.0).otherwise(1.0)
    exponent, fraction = F.shiftright(bits, 10).bitwiseAND(31), bits.bitwiseAND(1023)
    return (
        F.when((exponent == 31) & (fraction != 0), float("nan")).when(exponent == 31, sign * float("inf"))
        .when(exponent == 0, sign * fraction * 2.0**-24).otherwise(sign * (1 + fraction / 1024.0) * F.pow(F.lit(2.0), exponent - 15))
    )


def bits_of_half(x: Column) -> Column:
    """The 16 bits of a non-negative double that is a half float's value, as half() gives it."""
    exponent = F.greatest(F.floor(F.log2(F.greatest(x, F.lit(1e-300)))), F.lit(-14))
    return ((exponent + 14) * 1024 + x * F.pow(F.lit(2.0), 10 - exponent)).cast("int")


def padded_length(n: Column, group: int) -> Column:
    return n + F.pmod(-n, F.lit(group))


def quantized(tensors: DataFrame, key: str, values: str, bits: int = 8, group: int = 32, single: bool = False) -> DataFrame:
    """key, group_no, w, scale, q: symmetric codes by groups of consecutive weights, the last group padded with zeros.
    The scale is a half float before it divides; codes round to even and stay within +- (2 ** (bits - 1) - 1).
    Quotients are doubles, or singles if asked."""
    rounded = lambda x: x.cast("float").cast("double") if single else x
    qmax = (1 << (bits - 1)) - 1
    v = F.col(values).cast("array<double>")
    padded = F.concat(v, F.array_repeat(F.lit(0.0), F.pmod(-F.size(v), F.lit(group)).cast("int")))
    cut = tensors.select(key, padded.alias("v")).where(F.size("v") > 0)
    groups = cut.select(key, "v", F.explode(F.sequence(F.lit(0), (F.size("v") / group).cast("int") - 1)).alias("group_no"))
    groups = groups.select(key, "group_no", F.slice("v", F.col("group_no") * group + 1, group).alias("w"))
    peak = F.array_max(F.transform("w", lambda x: F.abs(x)))
    scaled = groups.withColumn("scale", half(F.greatest(rounded(peak / qmax), rounded(F.lit(LEAST_SCALE)))))
    return scaled.withColumn("q", F.transform("w", lambda x: F.greatest(F.least(F.rint(rounded(x / F.col("scale"))), F.lit(float(qmax))), F.lit(float(-qmax))).cast("int"))).select(key, "group_no", "w", "scale", "q")


def packed_int4(q: Column) -> Column:
    """Hex of the codes' nibbles, the first of each pair low; an odd last one gets a zero."""
    padded = F.concat(q, F.array_repeat(F.lit(0), F.pmod(F.size(q), F.lit(2))))
    bytes_ = F.transform(F.sequence(F.lit(0), F.greatest((F.size(padded) / 2).cast("int") - 1, F.lit(0))), lambda i: F.get(padded, 2 * i).bitwiseAND(15) + 16 * F.get(padded, 2 * i + 1).bitwiseAND(15))
    return F.when(F.size(q) == 0, "").otherwise(F.array_join(F.transform(bytes_, lambda b: F.lpad(F.hex(b), 2, "0")), ""))


def unpacked_int4(packed: Column, count: Column) -> Column:
    """The codes of packed_int4, a nibble above 7 being negative."""
    nibble = lambda at: F.conv(F.substr(packed, at, F.lit(1)), 16, 10).cast("int")
    low_first = F.transform(F.sequence(F.lit(0), count - 1), lambda i: nibble(F.when(i % 2 == 0, i + 2).otherwise(i)))
    return F.transform(low_first, lambda v: F.when(v > 7, v - 16).otherwise(v))


def base85(raw: Column) -> Column:
    """The base85 digits of binary values."""
    return functions_base85.encoded(F.hex(raw))


def unbase85(text: Column) -> Column:
    """The binary value of base85 digits; null for what none has."""
    return F.unhex(functions_base85.decoded(text))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def linear(x: Column, rows: list[list[float]]) -> Column:
    """y = W x for a small weight matrix given by rows."""
    return F.array(*[dot(x, F.array(*[F.lit(float(w)) for w in row])) for row in rows])


def mean(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """Biased variance, no gain or bias. x should be a stored column: it is read for every element."""
    m = mean(x)
    variance = F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x) - m * m
    return F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(F.struct(m.alias("m"), F.sqrt(F.greatest(variance, F.lit(0.0)) + eps).alias("d")), F.size(x)).alias("s")), lambda z: (z["v"] - z["s"]["m"]) / z["s"]["d"])


def softmax(x: Column) -> Column:
    top = F.array_max(x)
    shifted = F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(top, F.size(x)).alias("t")), lambda z: F.exp(z["v"] - z["t"]))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.arrays_zip(shifted.alias("v"), F.array_repeat(total, F.size(x)).alias("t")), lambda z: z["v"] / z["t"])


def top_k(x: Column, k: int) -> Column:
    """Values below the k-th largest become null; ties with it stay."""
    kth = F.get(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)) - 1)
    return F.transform(F.arrays_zip(x.alias("v"), F.array_repeat(kth, F.size(x)).alias("t")), lambda z: F.when(z["v"] >= z["t"], z["v"]))


def cross_entropy(logits: Column, target: Column) -> Column:
    """-log softmax(logits)[target], null where the target is negative (ignored)."""
    top = F.array_max(logits)
    total = F.aggregate(F.transform(F.arrays_zip(logits.alias("v"), F.array_repeat(top, F.size(logits)).alias("t")), lambda z: F.exp(z["v"] - z["t"])), F.lit(0.0), lambda s, v: s + v)
    return F.when(target >= 0, F.log(total) + top - F.get(logits, target))


def learning_rate(step: Column, steps: int, peak: float, least: float, warmup: int) -> Column:
    """Linear warm-up, then a cosine down to ``least``."""
    along = F.least((step - warmup) / float(max(1, steps - warmup)), F.lit(1.0))
    return F.when(step < warmup, peak * (step + 1) / float(warmup)).otherwise(least + 0.5 * (peak - least) * (1 + F.cos(along * math.pi)))


# Model sizes as (name, layers, heads, width, block).
PRESETS = [("greeter", 2, 4, 40, 128), ("tiny", 2, 4, 64, 64), ("small", 3, 4, 96, 96), ("medium", 4, 4, 128, 128), ("large", 6, 6, 192, 192)]


def parameter_shapes(vocab: int, layers: int, width: int, block: int) -> list[tuple[str, list[int]]]:
    """Tensor names and shapes of the decoder in operators.network; the head is tied to the embedding."""
    out: list[tuple[str, list[int]]] = [("tok_emb.weight", [vocab, width]), ("pos_emb.weight", [block, width])]
    for i in range(layers):
        p = f"blocks.{i}."
        out += [(p + "ln1.weight", [width]), (p + "ln1.bias", [width]), (p + "attn.qkv.weight", [3 * width, width]), (p + "attn.qkv.bias", [3 * width]), (p + "attn.proj.weight", [width, width]), (p + "attn.proj.bias", [width]),
                (p + "ln2.weight", [width]), (p + "ln2.bias", [width]), (p + "mlp.fc.weight", [4 * width, width]), (p + "mlp.fc.bias", [4 * width]), (p + "mlp.proj.weight", [width, 4 * width]), (p + "mlp.proj.bias", [width])]
    return [*out, ("ln_f.weight", [width]), ("ln_f.bias", [width])]
