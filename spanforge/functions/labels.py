"""Display names and classifications as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Shader-name prefixes and the op kind each stands for, most
# specific first.
OP_PREFIXES = (
    ("quantized_matmul", "QuantizedMatmul"), ("affine_qmm", "QuantizedMatmul"),
    ("qmv", "QuantizedMatmul"), ("qvm", "QuantizedMatmul"), ("qmm", "QuantizedMatmul"),
    ("steel_gemm", "Matmul"), ("gemm", "Matmul"), ("gemv", "Matmul"),
    ("steel_attention", "ScaledDotProductAttention"), ("sdpa", "ScaledDotProductAttention"),
    ("block_softmax", "Softmax"), ("softmax", "Softmax"), ("rms_norm", "RMSNorm"),
    ("layer_norm", "LayerNorm"), ("gelu", "GeLU"), ("silu", "SiLU"), ("rope", "RoPE"),
    ("implicit_gemm_conv", "Conv"), ("winograd_conv", "Conv"), ("conv2d", "Conv2d"),
    ("conv", "Conv"), ("all_reduce", "Reduce"), ("row_reduce", "Reduce"),
    ("col_reduce", "Reduce"), ("reduce", "Reduce"), ("contig_scan", "Scan"), ("scan", "Scan"),
    ("sort", "Sort"), ("gather", "Gather"), ("scatter", "Scatter"), ("arange", "Arange"),
    ("rbits", "Random"), ("copy", "Copy"), ("affine_quantize", "Quantize"),
    ("quantize", "Quantize"), ("dequantize", "Dequantize"),
)

# Names of command-buffer error codes.
ERROR_NAMES = {
    1: "Timeout", 2: "OutOfMemory", 3: "PageFault", 4: "AccessViolation",
    5: "InvalidResource", 6: "Blacklisted", 14: "ImpactingInteractivity",
}
ERROR_NAME_PREFIX = "kIOGPUCommandBufferCallbackError"
WATCHDOG_CODES = (1, 14)


def op_kind(symbol: Column) -> Column:
    """Canonical kind of a shader symbol, null when no rule fits."""
    by_prefix = reduce(
        lambda acc, pk: acc.when(symbol.startswith(pk[0]), F.lit(pk[1])),
        OP_PREFIXES[1:], F.when(symbol.startswith(OP_PREFIXES[0][0]), F.lit(OP_PREFIXES[0][1])))
    return (by_prefix
            .when(symbol.rlike("^[gsvn0-9]+_copy"), "Copy")
            .when(symbol.rlike("^[gsvn0-9]+_[A-Z]"), "Elementwise")
            .when(symbol.endswith("_contiguous") | symbol.endswith("_strided"), "FusedElementwise"))


def op_label(symbol: Column, name: Column) -> Column:
    """Kind, else symbol, else raw name."""
    return F.coalesce(op_kind(symbol), symbol, name)


def error_name(code: Column) -> Column:
    known = reduce(lambda acc, kv: acc.when(code == kv[0], F.lit(ERROR_NAME_PREFIX + kv[1])),
                   list(ERROR_NAMES.items())[1:],
                   F.when(code == 1, F.lit(ERROR_NAME_PREFIX + ERROR_NAMES[1])))
    return known.otherwise(F.lit(ERROR_NAME_PREFIX + "Unknown"))


def is_watchdog(code: Column) -> Column:
    return code.isin(*WATCHDOG_CODES)


def kill_reason_text(reason: Column) -> Column:
    """What a kill reason says about whose memory ran out."""
    return (F.when(reason == "per-process-limit", "the process passed its own limit")
            .when(reason == "vm-pageshortage", "the whole machine ran short of memory")
            .when(reason.isNotNull(), F.concat(F.lit("kernel reason: "), reason)))


def kernel_fingerprint(pso: Column, w: Column, h: Column, d: Column) -> Column:
    return F.format_string("K_%04x_%dx%dx%d", pso.bitwiseAND(65535), w, h, d)


def key_bucket(key: Column, buckets: int = 8) -> Column:
    """Stable small bucket of a key, for colouring: its bytes as digits to the base 31, in 32 bits."""
    digits = F.hex(F.encode(key, "UTF-8"))
    step = lambda a, i: F.pmod(a * 31 + F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("bigint"), F.lit(1 << 32))
    places = F.sequence(F.lit(1), F.octet_length(key))
    return F.when(F.octet_length(key) > 0, F.aggregate(places, F.lit(0).cast("bigint"), step) % buckets).when(key == "", 0).cast("int")


def likely_async(duration_ns: Column, threshold_ns: int = 10_000_000) -> Column:
    return duration_ns < threshold_ns


def caller_frames(frames: Column, own_prefix: str, depth: int = 5) -> Column:
    """Stack frames outside the capturing package, at most ``depth``."""
    return F.slice(F.filter(frames, lambda f: ~f["filename"].startswith(own_prefix)), 1, depth)
