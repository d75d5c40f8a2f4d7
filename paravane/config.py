"""Run configurations: YAML files checked against tables of their fields, on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from types import SimpleNamespace
from typing import Any

import yaml

from paravane.functions.text import NORMALIZERS
from paravane.operators.clean import CleanOptions
from paravane.registry import AUGMENTERS
from paravane.schemas import VARIANTS
from paravane.sources import providers  # noqa: F401  registers the augmenters


@dataclass(frozen=True)
class Need:
    """A field that a file must give: its types."""

    types: tuple[type, ...]


@dataclass(frozen=True)
class May:
    """A field with a default: its types, or None where that is the default."""

    default: Any
    types: tuple[type, ...] = ()


@dataclass(frozen=True)
class OneOf:
    """A field that takes some values only, or stays at its default."""

    values: tuple
    default: Any = None


TEXT, WHOLE, FLAG, NUMBER, LIST = (str,), (int,), (bool,), (float, int), (list,)

#: The fields of the three kinds of configuration files and their defaults.
CLEAN = {
    "dataset": Need(TEXT),
    "seed": Need(WHOLE),
    "hf_revision": Need(TEXT),
    "length": {"min_tokens": Need(WHOLE), "max_tokens": Need(WHOLE)},
    "max_rows": Need((int, type(None))),
    "normalize": Need(LIST),
    "dedupe": Need(FLAG),
    "subjects": May(None, LIST),
}
AUGMENT = {
    "dataset": Need(TEXT),
    "seed": May(0, WHOLE),
    "augmenter": Need(TEXT),
    "augmenter_model": Need(TEXT),
    "decoding": {"temperature": May(0.7, NUMBER), "max_output_tokens": May(512, WHOLE)},
    "judge": {"temperature": May(0.0, NUMBER), "max_output_tokens": May(16, WHOLE)},
    "retry": {"max_attempts": May(3, WHOLE), "backoff_seconds": May(2.0, NUMBER)},
    "prompts": {"paraphrase": Need(TEXT), "idiomatic": Need(TEXT)},
    "validators": {
        "semantic_similarity": {"embedding_model": May(None, TEXT), "min_cosine": May(0.80, NUMBER)},
        "label_preservation": {"method": May("llm_judge", TEXT), "prompt": May(None, TEXT)},
        "idiom_presence": {"method": May("llm_judge", TEXT), "prompt": May(None, TEXT)},
        "idiom_absence": {"method": May("llm_judge", TEXT), "prompt": May(None, TEXT)},
    },
    "cache": {"enabled": May(True, FLAG), "dir": May(".hf_cache/augment", TEXT)},
}
EVAL = {
    "model": Need(TEXT),
    "seed": May(0, WHOLE),
    "precision": OneOf(("fp32", "fp16", "bf16")),
    "decoding": {"temperature": May(0.0, NUMBER), "max_new_tokens": May(32, WHOLE), "do_sample": May(False, FLAG)},
    "batch": {"size": May(8, WHOLE)},
}


def _fits(value: Any, types: tuple[type, ...]) -> bool:
    return isinstance(value, types) and (bool in types or not isinstance(value, bool))


def checked(fields: dict, given: Any, where: str, faults: list[str]) -> dict:
    """The given values with defaults filled in; what does not fit the fields is added to ``faults``."""
    if not isinstance(given, dict):
        faults.append(f"{where or 'the file'} must hold keys and values")
        return {}
    faults += [f"unknown key {where}{k}" for k in given if k not in fields]
    out = {}
    for name, rule in fields.items():
        at = f"{where}{name}"
        if isinstance(rule, dict):
            out[name] = checked(rule, given.get(name, {}), f"{at}.", faults)
        elif name not in given:
            out[name] = getattr(rule, "default", None)
            if isinstance(rule, Need):
                faults.append(f"missing key {at}")
        else:
            out[name] = value = given[name]
            if isinstance(rule, OneOf):
                fits = value == rule.default or value in rule.values
            else:
                fits = _fits(value, rule.types) or (isinstance(rule, May) and value is None and rule.default is None)
            if not fits:
                faults.append(f"{at} cannot be {value!r}")
    return out


class Config(SimpleNamespace):
    """A checked configuration; nested tables are configurations, too."""

    FIELDS: dict = {}

    def model_dump(self) -> dict:
        return {k: v.model_dump() if isinstance(v, Config) else v for k, v in vars(self).items()}

    @classmethod
    def of(cls, given: Any) -> Config:
        faults: list[str] = []
        values = checked(cls.FIELDS, given, "", faults)
        if not faults:
            faults += cls.more_faults(values)
        if faults:
            raise ValueError("; ".join(faults))
        nested = lambda v: Config(**{k: nested(w) for k, w in v.items()}) if isinstance(v, dict) else v
        return cls(**{k: nested(v) for k, v in values.items()})

    @staticmethod
    def more_faults(values: dict) -> list[str]:
        """What no single field shows."""
        return []


class CleanConfig(Config):
    FIELDS = CLEAN

    @staticmethod
    def more_faults(values: dict) -> list[str]:
        return [f"unknown normalizer {n!r}" for n in values["normalize"] if n not in NORMALIZERS]

    def options(self) -> CleanOptions:
        return CleanOptions(tuple(self.normalize), self.length.min_tokens, self.length.max_tokens, self.dedupe, self.seed, self.max_rows)


class AugmentConfig(Config):
    FIELDS = AUGMENT

    @staticmethod
    def more_faults(values: dict) -> list[str]:
        name = values["augmenter"]
        return [] if name in AUGMENTERS.names() else [f"unknown augmenter {name!r}; known: {AUGMENTERS.names()}"]


class EvalConfig(Config):
    FIELDS = EVAL

    @staticmethod
    def more_faults(values: dict) -> list[str]:
        return ["decoding.temperature cannot be below 0"] if values["decoding"]["temperature"] < 0 else []


def load(kind: type[Config], path: str | Path, **overrides: Any) -> Any:
    """A checked configuration; overrides (a seed from the command line) win over the file."""
    raw = yaml.safe_load(Path(path).read_text()) or {}
    return kind.of(raw | {k: v for k, v in overrides.items() if v is not None} if isinstance(raw, dict) else raw)


def resolve_variants(on_disk: set[str], wanted: list[str] | None = None) -> list[str]:
    """The wanted variants, checked, or those on disk, in canonical order."""
    if wanted is None:
        return [v for v in VARIANTS if v in on_disk]
    if unknown := [v for v in wanted if v not in VARIANTS]:
        raise ValueError(f"unknown variants: {unknown}")
    if missing := [v for v in wanted if v not in on_disk]:
        raise ValueError(f"variants without a file: {missing}")
    return list(wanted)
