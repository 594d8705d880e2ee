"""Parameters of corpus preparation, checked before any plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

IGNORE_LABEL = -100


@dataclass(frozen=True)
class Specials:
    """Ids of the special tokens; ``eos`` and ``bos`` are required."""

    eos: int | None
    bos: int | None
    unk: int | None = None
    pad: int | None = None
    eot: int | None = None
    others: tuple[int, ...] = ()

    def __post_init__(self):
        if self.bos is None:
            raise ValueError("a BOS id is required")
        if self.eos is None:
            raise ValueError("an EOS id is required")

    def with_pad_fallback(self) -> Specials:
        """Pad with EOS where no pad token exists."""
        return self if self.pad is not None else replace(self, pad=self.eos)

    def ids(self) -> list[int]:
        """All special ids, which decoding leaves out."""
        return sorted({i for i in (self.pad, self.eos, self.bos, self.unk, self.eot, *self.others) if i is not None})


@dataclass(frozen=True)
class PrepareParams:
    """One preparation run: split sizes, block length and packing groups.

    ``grouping="batches"`` packs every run of ``batch_rows`` documents of each
    of ``shards`` contiguous shards alone; ``grouping="global"`` packs a split as
    one stream. ``encoding`` is the form that looks words up: ``"lookup"`` beside the scan, or
    ``"join"`` for a vocabulary too large to broadcast. ``shuffle`` is how a holdout orders the train split:
    ``"sorted"`` by a keyed hash of the ids, or ``"permuted"`` by a keyed permutation of known positions.
    """

    max_seq_length: int = 8192
    n_train: int | None = None
    n_val: int | None = None
    n_test: int | None = None
    use_packing: bool = True
    shards: int = 12
    batch_rows: int = 1000
    grouping: str = "batches"
    seed: int = 42
    text_column: str = "text"
    on_null: str = "fail"
    encoding: str = "lookup"
    shuffle: str = "sorted"

    def __post_init__(self):
        for name in ("n_train", "n_val", "n_test"):
            if (getattr(self, name) or 0) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("max_seq_length", "shards", "batch_rows"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.use_packing:
            check_block_length(self.max_seq_length)
        if self.grouping not in ("batches", "global"):
            raise ValueError("grouping must be 'batches' or 'global'")
        if self.on_null not in ("fail", "drop"):
            raise ValueError("on_null must be 'fail' or 'drop'")
        if self.encoding not in ("lookup", "join"):
            raise ValueError("encoding must be 'lookup' or 'join'")
        if self.shuffle not in ("sorted", "permuted"):
            raise ValueError("shuffle must be 'sorted' or 'permuted'")


def check_block_length(length: int) -> None:
    if length < 2:
        raise ValueError(f"block length {length} must be at least 2: one BOS and one token")


DEFAULT = PrepareParams()
SMOKE = PrepareParams(max_seq_length=128, n_train=2, n_val=2, n_test=2, shards=1)
