"""Label scheme: the two label levels, the split names and the vote rule.

The names below are fixed values that must equal the reference's label
dictionary and dataset layout for results to agree.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values (reference label dictionary, split names, vote rule) ----
LEVEL1_LABELS = ("NO", "YES")
LEVEL2_LABELS = (
    "-",
    "IDEOLOGICAL-INEQUALITY",
    "STEREOTYPING-DOMINANCE",
    "OBJECTIFICATION",
    "SEXUAL-VIOLENCE",
    "MISOGYNY-NON-SEXUAL-VIOLENCE",
)
TRAIN_SPLITS = ("TRAIN_EN",)
TRAIN_SPLITS_MULTILINGUAL = ("TRAIN_EN", "TRAIN_ES")
TEST_SPLITS = ("DEV_EN",)
TIE_VOTES = 3          # the negative label got exactly half of six votes
MIN_CATEGORY_VOTES = 2  # a category is applied with at least two votes
# Labels of the third-party multi-label scorer used in the group study.
GROUP_STUDY_LABELS = (
    "Profanity", "Insults", "Char. Assassination", "Outrage",
    "Discrimination", "Hostility", "Incivility", "Intolerance",
)
# --------------------------------------------------------------------------

STATUS_OK = "ok"
STATUS_TIE = "tie"
STATUS_NO_MAJORITY = "no_majority"


@dataclass(frozen=True)
class LabelScheme:
    """Two-level label scheme; index 0 of each level is the negative label."""

    level1: tuple[str, ...] = LEVEL1_LABELS
    level2: tuple[str, ...] = LEVEL2_LABELS
    tie_votes: int = TIE_VOTES
    min_category_votes: int = MIN_CATEGORY_VOTES
    dataset: str = "EXIST"
    splits: dict = field(default_factory=lambda: {
        "train": TRAIN_SPLITS, "train_multilingual": TRAIN_SPLITS_MULTILINGUAL,
        "test": TEST_SPLITS})

    @property
    def n_categories(self) -> int:
        return len(self.level2)

    def labels(self, level: int) -> tuple[str, ...]:
        if level == 1:
            return self.level1
        if level == 2:
            return self.level2
        raise ValueError(f"level must be 1 or 2, got {level}")

    def split_values(self, split: str, multilingual: bool = False):
        """Split filter values; ``None`` means keep every row."""
        if split == "train":
            return self.splits["train_multilingual" if multilingual else "train"]
        if split == "test":
            return self.splits["test"]
        return None


DEFAULT_SCHEME = LabelScheme()


def scheme_for(dataset: str) -> LabelScheme:
    """Scheme registry; only the EXIST layout is known."""
    if dataset != "EXIST":
        raise ValueError(f"unsupported dataset {dataset!r}; only 'EXIST' is known")
    return DEFAULT_SCHEME
