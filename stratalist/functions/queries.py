"""Search phrases from preferences. A few dozen strings, made on the driver; ``query_table`` makes a frame of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

# Phrases that a term also stands for, what marks an internship, and the bounds.
EXPANSIONS = {
    "fpga": ["FPGA engineer", "FPGA design", "FPGA verification", "programmable logic", "RTL"],
    "rtl": ["RTL design", "RTL engineer", "digital design", "logic design"],
    "asic": ["ASIC design", "ASIC engineer", "silicon design", "SoC design"],
    "verification": ["design verification", "RTL verification", "ASIC verification", "SoC verification", "UVM", "pre-silicon verification"],
    "hardware verification": ["design verification", "RTL verification", "UVM verification", "hardware validation"],
    "digital design": ["digital design engineer", "logic design", "RTL design"],
    "computer architecture": ["computer architecture", "microarchitecture", "CPU architecture", "GPU architecture"],
    "embedded": ["embedded software", "embedded systems", "firmware", "device driver"],
    "hardware security": ["hardware security", "silicon security", "secure hardware", "side-channel"],
    "ml hardware": ["ML accelerator", "AI hardware", "deep learning hardware", "AI accelerator"],
    "low-latency": ["low latency", "high frequency trading hardware", "FPGA trading"],
    "low latency": ["low latency", "FPGA trading", "hardware acceleration"],
    "signal processing": ["DSP", "signal processing", "digital signal processing"],
    "software engineer": ["software engineering", "software developer", "SWE"],
    "systemverilog": ["SystemVerilog", "Verilog", "RTL"],
    "uvm": ["UVM", "verification methodology", "testbench"],
    "physical design": ["physical design", "place and route", "static timing analysis"],
    "analog": ["analog design", "mixed signal", "circuit design"],
    "robotics": ["robotics engineer", "controls engineer", "autonomy"],
    "machine learning": ["machine learning", "deep learning", "ML engineer"],
}
INTERN_WORDS = ["intern", "internship"]
KEYWORDS, PLACES, TARGETED = 12, 4, 3


def _plain(text: str) -> str:
    return " ".join(text.lower().split())


def keep_first(values: Iterable[str]) -> list[str]:
    """The values in order, without blanks and later ones that differ in case or white space only."""
    kept: dict[str, str] = {}
    for v in values:
        if _plain(v):
            kept.setdefault(_plain(v), v)
    return list(kept.values())


def expand(role: str, enabled: bool = True) -> list[str]:
    """The role, and what the first term that it holds also stands for; without one, the role without its word for an internship."""
    stem = _plain(role)
    for word in INTERN_WORDS:
        stem = _plain(stem.replace(word, ""))
    more = next((found for term, found in EXPANSIONS.items() if term in _plain(role)), [stem]) if enabled and stem else []
    return keep_first([role.strip(), *more])


def search_phrases(roles: list[str], keywords: Iterable[str] = (), places: Iterable[str] = (), *, internships: bool = True, limit: int = 60) -> list[tuple[str, str | None]]:
    """(phrase, place) pairs: all phrases without a place, then the first few at the first few places, at most ``limit``."""
    if not roles:
        return [("engineering intern", None)]
    phrases = keep_first([p for r in roles for p in expand(r)] + [f"{k} intern" for k in list(keywords)[:KEYWORDS]])
    if internships:
        phrases = [p if any(w in _plain(p) for w in INTERN_WORDS) else f"{p} intern" for p in phrases]
    phrases = phrases[:limit]
    pairs = [(p, None) for p in phrases] + [(p, at) for p in phrases[:TARGETED] for at in list(places)[:PLACES]]
    kept: dict[tuple, tuple[str, str | None]] = {}
    for p, at in pairs[:limit]:
        kept.setdefault((_plain(p), at), (p, at))
    return list(kept.values())


def query_table(spark: SparkSession, pairs: list[tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame(pairs, "phrase string, place string")
