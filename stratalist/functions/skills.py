"""Skills that a text names, from a closed vocabulary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The vocabulary, and the contexts that words with a second meaning need.
VOCABULARY = [
    "fpga", "rtl", "systemverilog", "verilog", "vhdl", "uvm", "asic", "soc", "verification", "validation", "synthesis", "timing analysis", "sta", "place and route", "physical design", "dft",
    "scan", "jtag", "axi", "ahb", "pcie", "ddr", "hbm", "ethernet", "usb", "i2c", "spi", "uart", "can bus", "vivado", "vitis", "quartus", "questasim", "modelsim", "vcs", "verdi", "synopsys",
    "cadence", "xilinx", "altera", "intel quartus", "yosys", "cocotb", "chisel", "hls", "opencl", "cuda", "tensorrt", "verilator", "computer architecture", "microarchitecture", "cpu", "gpu",
    "tpu", "npu", "riscv", "risc-v", "arm", "x86", "mips", "embedded", "firmware", "rtos", "freertos", "bare metal", "device driver", "linux kernel", "yocto", "zephyr", "microcontroller",
    "stm32", "arduino", "c", "c++", "python", "rust", "go", "java", "javascript", "typescript", "matlab", "scala", "haskell", "ocaml", "perl", "tcl", "bash", "assembly", "pytorch",
    "tensorflow", "jax", "numpy", "pandas", "scikit-learn", "machine learning", "deep learning", "reinforcement learning", "nlp", "computer vision", "llm", "transformers", "docker",
    "kubernetes", "aws", "gcp", "azure", "terraform", "ci/cd", "git", "jenkins", "sql", "postgresql", "redis", "kafka", "spark", "react", "node.js", "django", "flask", "fastapi", "graphql",
    "signal processing", "dsp", "rf", "analog", "mixed signal", "power", "hardware security", "cryptography", "side channel", "fault injection", "secure boot", "tpm", "trustzone",
    "formal verification", "model checking", "low latency", "high frequency trading", "networking", "tcp/ip", "rdma", "distributed systems", "operating systems", "compilers", "llvm",
]
AMBIGUOUS = {
    "c": r"\bc/c\+\+|\bc\+\+/c\b|\b(?:program\w*|cod\w+|develop\w*|written|writing|proficien\w+|experience|fluent|skills?)[^.]{0,30}?\bin\s+c\b|\b(?:embedded|ansi|bare[\s-]?metal)\s+c\b|\bc\s+(?:programming|language|compiler)\b",
    "go": r"\bgolang\b|\bgo\s+(?:programming|language)\b|\b(?:in|using|with)\s+go\b",
    "rf": r"\brf\s+(?:design|engineer\w*|circuit\w*|front[\s-]?end|system\w*|test\w*)\b|\bradio\s+frequency\b",
    "arm": r"\barm\s+(?:cortex|architecture|processor|core|assembly|v\d)\b|\bcortex[\s-]?[amr]\b|\barm64\b",
    "power": r"\bpower\s+(?:electronics|management|integrity|supply|converter|rail|delivery)\b|\blow[\s-]?power\s+design\b",
}
SHORT = 3


def _quoted(word: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in word)


#: A pattern or words without which an ambiguous skill is not named, as a search for these is cheaper.
NEEDED = {"c": r"\bc\b", "go": ["go"], "rf": ["rf", "radio"], "arm": ["arm", "cortex"], "power": ["power"]}


def _named(low: Column, skill: str) -> Column:
    if skill in AMBIGUOUS:
        need = NEEDED[skill]
        first = low.rlike(need) if isinstance(need, str) else reduce(lambda x, y: x | y, [F.contains(low, F.lit(w)) for w in need])
        return first & low.rlike(AMBIGUOUS[skill])
    hit = F.contains(low, F.lit(skill))
    return hit & low.rlike(rf"(?<![a-z0-9+#]){_quoted(skill)}(?![a-z0-9+#])") if len(skill) <= SHORT else hit


def extract_skills(text: Column) -> Column:
    """The skills that a text names, in order of the vocabulary. Words of three letters or fewer must stand alone."""
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.array_compact(F.array(*[F.when(_named(low, s), F.lit(s)) for s in VOCABULARY])))
