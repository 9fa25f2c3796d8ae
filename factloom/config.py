"""Typed options with defaults, validation and a description of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace


def _option(default, doc: str, allowed=None):
    return field(default=default, metadata={"doc": doc, "allowed": allowed})


@dataclass(frozen=True)
class _Options:
    def __post_init__(self):
        for f in fields(self):
            allowed, value = f.metadata.get("allowed"), getattr(self, f.name)
            if callable(allowed) and not allowed(value) or isinstance(allowed, tuple) and value not in allowed:
                raise ValueError(f"{type(self).__name__}.{f.name} can't be {value!r}")

    def with_flag(self, name: str, value) -> _Options:
        """A copy with one option changed and checked."""
        if name not in {f.name for f in fields(self)}:
            raise KeyError(name)
        return replace(self, **{name: value})

    @classmethod
    def describe(cls) -> list[tuple[str, object, str]]:
        return [(f.name, f.default, f.metadata["doc"]) for f in fields(cls)]


@dataclass(frozen=True)
class SessionOptions(_Options):
    """Options of a data set and of cross-validation."""

    referential_integrity_repair: str = _option("ignore", "what to do with references to missing entities", ("ignore", "add", "delete"))
    check_duplicate_ids: bool = _option(False, "look for entities that occur twice")
    debug_messages: bool = _option(True, "log progress")
    kfold_random_seed: int = _option(0, "seed of the partitions", lambda x: x >= 0)
    pthreshold: float = _option(0.0, "margin above which a fact is induced")
    clobber: bool = _option(False, "write over existing results")
    n_debug_graphs: int = _option(5, "how many graphs are exported for inspection", lambda x: x >= 0)


MATCH_TYPES = ("hard", "hard_propertyless", "multiview", "soft", "hard_soft", "mixed")
#: Kernels that users add: name to (a, b, d, r, hashed) -> key of a pair, from the codes of both neighbourhoods, distance and radius as Columns.
PAIR_KEYS: dict[str, Callable] = {}


def register_kernel(name: str, pair_key: Callable) -> None:
    """Adds a member of the kernel family, then named by ``KernelOptions(variant=name)``; ``hashed`` hashes a list of numbers and Columns."""
    if name in VARIANTS or name in PAIR_KEYS:
        raise ValueError(f"kernel {name} exists")
    PAIR_KEYS[name] = pair_key


VARIANTS = ("nspdk", "mnspdk", "rnspdk", "anspdk", "alnspdk", "nspdk3d", "gnspdk")


@dataclass(frozen=True)
class KernelOptions(_Options):
    """Options of a graph kernel."""

    variant: str = _option("nspdk", "member of the kernel family", lambda x: x in VARIANTS or x in PAIR_KEYS)
    radius: int = _option(0, "largest radius of neighbourhoods", lambda x: 0 <= x <= 8)
    distance: int = _option(0, "largest distance between centres", lambda x: 0 <= x <= 16)
    match_type: str = _option("hard", "how neighbourhoods are compared", MATCH_TYPES)
    normalization: bool = _option(True, "scale vectors so that each group weighs the same")
    min_kernel: bool = _option(False, "unary features for the minimum kernel")
    hash_bit_mask: int = _option(2**31 - 1, "mask of the feature space", lambda x: 0 < x < 2**32)


@dataclass(frozen=True)
class SgdOptions(_Options):
    """Options of the stochastic-gradient models."""

    loss: str = _option("hinge", "loss function", ("hinge", "log", "exponential", "squared", "epsilon"))
    epochs: int = _option(5, "passes over the training cases; of a block in a round where folds train together", lambda x: x > 0)
    lambda_: float = _option(0.001, "weight of the regulariser", lambda x: x > 0)
    lossratio: float = _option(1.0, "factor on the gradients of negative cases", lambda x: x > 0)
    seed: int = _option(1, "seed of the one shuffle")
    tolerance: float = _option(0.01, "gap to the optimum, relative to the cost, at which folds that train together end", lambda x: x > 0)


@dataclass(frozen=True)
class SvmOptions(_Options):
    """Options of the dual solvers."""

    c: float = _option(1.0, "cost of errors", lambda x: x > 0)
    nu: float = _option(0.5, "bound on the share of errors", lambda x: 0 < x <= 1)
    epsilon_tube: float = _option(0.1, "half width of the insensitive tube", lambda x: x >= 0)
    kernel: str = _option("linear", "kernel over feature vectors", ("linear", "poly", "rbf", "sigmoid", "precomputed"))
    gamma: float = _option(1.0, "factor of the dot product or distance")
    coef0: float = _option(0.0, "offset of poly and sigmoid")
    degree: int = _option(3, "degree of poly", lambda x: x > 0)
    tolerance: float = _option(1e-3, "stopping tolerance", lambda x: x > 0)
    wp: float = _option(1.0, "weight of positive cases", lambda x: x > 0)
    wn: float = _option(1.0, "weight of negative cases", lambda x: x > 0)
    max_cases: int = _option(20_000, "training cases that one solver task takes; more is an error", lambda x: x > 0)
