"""What may be plugged in - readers of lines and regions, decisions, renderers - and which of them a mode is made of.

A provider works on a whole DataFrame of pages, not on a page: its plan runs wherever the pages are. Calls of models are not made
here; their answers are columns or tables of the input.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import documents as D
from quire.sources import payloads as P


class OcrProvider(Protocol):
    """pages (doc_id, page, width, height, payload) to one row a line."""

    name: str

    def lines(self, pages: DataFrame) -> DataFrame: ...


class LayoutProvider(Protocol):
    """The same pages to one row a region."""

    name: str

    def regions(self, pages: DataFrame) -> DataFrame: ...


class Adjudicator(Protocol):
    """Blocks with candidates, an array of (text, confidence), to the same with selected, decision_confidence, decision_unresolved."""

    name: str

    def decide(self, blocks: DataFrame) -> DataFrame: ...


class Renderer(Protocol):
    """Blocks and pages to one row a paragraph."""

    def paragraphs(self, blocks: DataFrame, pages: DataFrame, polished: bool = False) -> DataFrame: ...


@dataclass(frozen=True)
class Reader:
    """A provider made of a function over payloads; it serves as either kind."""

    name: str
    read: Callable[[DataFrame], DataFrame]

    def lines(self, pages: DataFrame) -> DataFrame:
        return self.read(pages)

    def regions(self, pages: DataFrame) -> DataFrame:
        return self.read(pages)


class DisabledAdjudicator:
    """Selects nothing; every block stays open."""

    name = "disabled"

    def decide(self, blocks: DataFrame) -> DataFrame:
        return blocks.withColumns({"selected": F.lit(None).cast("string"), "decision_confidence": F.lit(0.0), "decision_unresolved": F.lit(True)})


class MostConfident:
    """Selects the candidate of the highest confidence, the first of equal ones; a block without candidates (or null) stays open."""

    name = "most confident"

    def decide(self, blocks: DataFrame) -> DataFrame:
        ranked = F.transform("candidates", lambda c, i: F.struct(c["confidence"].alias("confidence"), (-i).alias("place"), c["text"].alias("text")))
        best = F.array_max(ranked)
        chosen = {"selected": best["text"], "decision_confidence": F.coalesce(best["confidence"], F.lit(0.0)), "decision_unresolved": best.isNull()}
        return blocks.withColumns(chosen)


class PlanRenderer:
    """The paragraphs of pages; polished ones show the approved text where a block has one."""

    def paragraphs(self, blocks: DataFrame, pages: DataFrame, polished: bool = False) -> DataFrame:
        shown = blocks.withColumn("literal", F.coalesce("approved", "literal")) if polished else blocks
        return D.rendered(shown, pages)


LINES = {"local": Reader("local", P.local_lines), "windows": Reader("windows", P.desktop_lines), "azure": Reader("azure", P.cloud_blocks)}
REGIONS = {"local": Reader("local", P.local_regions), "full_page": Reader("full_page", P.full_page_layout), "mock": Reader("mock", lambda pages: P.full_page_layout(pages, 0.1))}
ADJUDICATORS = {"disabled": DisabledAdjudicator(), "most confident": MostConfident()}


@dataclass(frozen=True)
class Settings:
    """What a process is configured with. Keys are never shown, only that they are there."""

    azure_endpoint: str | None = None
    azure_key: str | None = None
    gemini_key: str | None = None
    gemini_model: str = ""
    verification_enabled: bool = False
    formatting_enabled: bool = False
    visual_qa_enabled: bool = False
    remote_endpoint: str | None = None
    quantized: bool = False
    gpu_memory_mb: int | None = None
    windows: bool = False
    packages: Mapping[str, str | None] = field(default_factory=dict)
    #: Memory that the gated model needs, the largest upload.
    least_gpu_memory_mb: int = 8192
    max_upload_mb: int = 500

    @property
    def azure_ready(self) -> bool:
        return bool(self.azure_endpoint and self.azure_key)

    @property
    def gemini_ready(self) -> bool:
        return self.gemini_key is not None


def preflight(settings: Settings) -> tuple[str, str]:
    """Kind and reason of the refusal of the gated model, which is never available."""
    if settings.remote_endpoint:
        return "remote-stub", "the remote endpoint's transport is not enabled"
    if settings.gpu_memory_mb is None:
        return "local", "no GPU was found"
    if settings.quantized:
        return "local-quantized-experimental", "quantized loading is disabled until it has a benchmark"
    enough = settings.gpu_memory_mb >= settings.least_gpu_memory_mb
    return "local-bf16", "local loading is not enabled" if enough else f"needs {settings.least_gpu_memory_mb} MB of GPU memory"


AVAILABILITY = "provider string, available boolean, requires_opt_in boolean, detail string"


def availability(settings: Settings) -> list[tuple[str, bool, bool, str]]:
    """A row a provider: whether it may run, whether that takes consent, and what else is known of it."""
    both = settings.azure_ready and settings.gemini_ready
    versions = ", ".join(f"{name} {version or 'absent'}" for name, version in sorted(settings.packages.items()))
    kind, reason = preflight(settings)
    return [
        ("local", bool(settings.packages) and all(settings.packages.values()), False, versions),
        ("windows", settings.windows, False, ""),
        ("azure", settings.azure_ready, True, ""),
        ("gemini", settings.gemini_ready, True, settings.gemini_model),
        ("ai_verified", settings.gemini_ready and settings.verification_enabled, True, "consented triggered crops"),
        ("hybrid", both, True, "disputed crops only"),
        ("maximum_accuracy", both and settings.verification_enabled, True, "consented crops and selected full pages"),
        ("unlimited", False, False, f"{kind}: {reason}"),
    ]


def public(settings: Settings) -> dict[str, object]:
    """What of the settings may be shown."""
    return {
        "azure_endpoint_configured": bool(settings.azure_endpoint),
        "azure_key_configured": settings.azure_key is not None,
        "gemini_key_configured": settings.gemini_ready,
        "gemini_model": settings.gemini_model,
        "verification_enabled": settings.verification_enabled,
        "formatting_enabled": settings.formatting_enabled,
        "visual_qa_enabled": settings.visual_qa_enabled,
        "secrets_persisted": False,
    }


#: The parts of each mode - lines, layout, verifier, and whether models may assist.
PARTS = {
    "mock": ("mock", "mock", None, False),
    "local": ("local", "local", "windows", True),
    "windows": ("windows", "full_page", None, False),
    "azure": ("azure", "full_page", None, False),
    "hybrid": ("azure", "full_page", "local", True),
    "ai_verified": ("local", "local", "windows", True),
    "maximum_accuracy": ("azure", "full_page", "local", True),
    "unlimited": ("unlimited", "local", "windows", False),
}

BUNDLE = "mode string, primary string, layout string, verifier string, adjudicator string, policy string, formatter boolean, visual_qa boolean"


def bundle(mode: str, settings: Settings, scope: str = "off", formatting: bool = False, visual_qa: bool = False) -> tuple:
    """The parts of a mode by name, as BUNDLE lists them. A mode that cannot run here raises; so does an unknown one."""
    if mode not in PARTS:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "unlimited":
        raise RuntimeError(preflight(settings)[1])
    if mode == "windows" and not settings.windows:
        raise RuntimeError("desktop recognition needs Windows")
    primary, layout, verifier, assisted = PARTS[mode]
    if verifier == "windows" and not settings.windows:
        verifier = None
    verified = assisted and scope != "off"
    return mode, primary, layout, verifier, "gemini" if verified else "disabled", scope if verified else None, assisted and formatting, assisted and visual_qa
