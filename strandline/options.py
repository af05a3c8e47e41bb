"""Options of building, querying, merging and reporting, with their normalisation."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from .functions.ranks import NONE, ROOT, SEQUENCE, SPECIES


@dataclass(frozen=True)
class SketchOptions:
    k: int = 16
    size: int = 16
    window: int = 127
    stride: int | None = None
    hash_name: str | None = None

    @property
    def step(self) -> int:
        return self.stride or self.window - self.k + 1

    def __post_init__(self):
        if not 1 <= self.k <= 32 or self.size < 1 or self.window < self.k or (self.stride is not None and self.stride < 1):
            raise ValueError(f"impossible sketching options: {self}")


@dataclass(frozen=True)
class BuildOptions:
    sketch: SketchOptions = field(default_factory=SketchOptions)
    max_locations: int = 254
    remove_overpopulated: bool = False
    remove_ambiguous_at: int | None = None
    max_ambiguous: int = 1
    sequence_id: str = "smart"
    reset_taxa: bool = False
    parts: int = 1


@dataclass(frozen=True)
class ClassifyOptions:
    lowest: int = SEQUENCE
    highest: int = 19
    hits_min: int = 0
    hits_diff: float = 1.0
    max_candidates: int = 2
    cov_percentile: float = 0.0
    insert_size: int = 0

    def normalised(self, sketch_size: int) -> ClassifyOptions:
        """Fractions over 1 are percent; no hits_min means one by sketch size; no candidate limit is none; ranks in order."""
        part = lambda x: x / 100 if x > 1 else max(0.0, x)
        least = self.hits_min or (sketch_size // 3 if sketch_size >= 6 else 2 if sketch_size >= 4 else 1)
        return replace(self, hits_min=least, hits_diff=part(self.hits_diff), cov_percentile=part(self.cov_percentile), max_candidates=self.max_candidates or 2**31 - 1, lowest=min(self.lowest, self.highest), highest=min(self.highest, ROOT))


@dataclass(frozen=True)
class QueryOptions:
    classify: ClassifyOptions = field(default_factory=ClassifyOptions)
    sketch: SketchOptions | None = None
    min_length: int = 0
    max_length: int = 2**31 - 1
    limit: int | None = None
    pairing: str = "none"
    max_locations: int | None = None


@dataclass(frozen=True)
class FormatOptions:
    taxids: bool = False
    taxids_only: bool = False
    omit_ranks: bool = False
    separate_cols: bool = False
    separator: str = "\t|\t"
    comment: str = "# "
    query_ids: bool = False
    lineage: bool = False
    map_view: str = "all"
    top_hits: bool = False
    all_hits: bool = False
    locations: bool = False
    ground_truth: bool = False
    lowest: int = SEQUENCE
    highest: int = 19

    def normalised(self) -> FormatOptions:
        """Separators may be written as \\t; other control characters go. Top hits without a map ask for mapped reads only, all hits for all reads."""
        sep = "".join(c for c in self.separator.replace("\\t", "\t") if c not in "\n\v\r\a")
        view = "mapped" if self.top_hits and self.map_view == "none" else "all" if self.all_hits else self.map_view
        return replace(self, separator=sep, map_view=view)

    @property
    def tokens(self) -> tuple[str, str, str, str]:
        """What stands after a rank, between taxa, and around a taxid that follows a name."""
        s = self.separator
        return (s, s, s, "") if self.separate_cols else (":", ",", "(", ")")


@dataclass(frozen=True)
class MergeOptions:
    classify: ClassifyOptions = field(default_factory=lambda: ClassifyOptions(lowest=SPECIES))

    def normalised(self) -> MergeOptions:
        """Merging knows no sequences: the lowest rank is at least species; without hits_min it is 5."""
        c = self.classify
        return MergeOptions(replace(c, lowest=max(c.lowest, SPECIES), hits_min=c.hits_min or 5, max_candidates=c.max_candidates or 2**31 - 1, highest=min(c.highest, NONE - 1)))
