"""Settings of a run. Defaults are those of the reference behaviour."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, replace

# The file kinds that are photos, and names that are passed over in silence.
EXTENSIONS = (".jpg", ".jpeg", ".heic", ".heif", ".3fr")
SILENT_NAMES = (".DS_Store",)
SILENT_EXTENSIONS = (".crdownload",)
STAGES = ("metadata", "preview", "thumb", "hash", "face", "person_mask", "image_metrics", "embedding", "iqa")
#: Direct dependencies of each analysis stage.
DEPENDS = {
    "metadata": (),
    "preview": (),
    "thumb": ("preview",),
    "hash": ("preview",),
    "face": ("preview",),
    "person_mask": ("preview", "face"),
    "image_metrics": ("preview", "person_mask"),
    "embedding": ("preview", "person_mask"),
    "iqa": ("preview",),
}


@dataclass(frozen=True)
class Config:
    """What segmenting, similarity and the choice of keepers depend on."""

    cache_dir: str = ".siftgrain"
    staging_dir: str = ".to_delete"
    hidden_prefix: str = ".siftgrain"
    ignored_dirs: tuple[str, ...] = (".siftgrain", ".siftgrain_cache", "__MACOSX")
    prune_staging: bool = True
    segment_gap_s: float = 3600.0
    pair_window_s: float = 1800.0
    neighbor_limit: int = 40
    multi: bool = True
    global_threshold: float = 0.86
    mixed_threshold: float = 0.90
    combined_threshold: float = 0.84
    background_veto: float = 0.60
    foreground_veto: float = 0.50
    foreground_area: float = 0.08
    weights: tuple[float, float, float] = (0.45, 0.30, 0.25)  #: global, background, foreground
    near_duplicate: float = 0.93
    max_keep: int = 3
    queue_size: int = 5
    time_zone: str = "UTC"
    env: str = field(default="SIFTGRAIN_MODEL_DIR", repr=False)

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """Defaults, with the values of a JSON file over them; unknown keys are an error."""
        if path is None:
            return cls()
        with open(path) as f:
            given = json.load(f)
        tuples = {k: tuple(v) if isinstance(v, list) else v for k, v in given.items()}
        return replace(cls(), **tuples)

    def model_dir(self) -> str | None:
        """The folder of model files that the environment names, if any."""
        return os.environ.get(self.env)

    def snapshot(self) -> str:
        """The settings as one line of JSON with sorted keys."""
        return json.dumps(asdict(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
