"""Named plug-ins: datasets, augmenters, validators, models and evaluators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Literal


class Registry:
    """Names to values; a second registration of a name and an unknown name are errors."""

    def __init__(self, kind: str):
        self.kind, self.entries = kind, {}

    def register(self, name: str) -> Callable:
        def take(value: Any) -> Any:
            if name in self.entries:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self.entries[name] = value
            return value

        return take

    def get(self, name: str) -> Any:
        if name not in self.entries:
            raise KeyError(f"unknown {self.kind} {name!r}; known: {', '.join(self.names())}")
        return self.entries[name]

    def names(self) -> list[str]:
        return sorted(self.entries)


@dataclass(frozen=True)
class ModelSpec:
    """A model that can be evaluated."""

    name: str
    repo: str
    revision: str
    kind: Literal["decoder"] = "decoder"
    default_precision: Literal["fp32", "fp16", "bf16"] = "bf16"

    def __post_init__(self) -> None:
        if self.kind != "decoder" or self.default_precision not in ("fp32", "fp16", "bf16"):
            raise ValueError(f"unsupported model specification {self}")


DATASETS, AUGMENTERS, VALIDATORS, MODELS, EVALUATORS = map(Registry, ("dataset", "augmenter", "validator", "model", "evaluator"))
register_dataset = DATASETS.register
register_augmenter = AUGMENTERS.register
register_validator = VALIDATORS.register
register_evaluator = EVALUATORS.register


def register_model(spec: ModelSpec) -> ModelSpec:
    return MODELS.register(spec.name)(spec)


#: The evaluated panel in ascending order of size: name, billions of parameters, display name, repository, revision.
PANEL = [
    ("qwen3.5-0.5b-instruct", 0.5, "Qwen2.5-0.5B", "Qwen/Qwen2.5-0.5B-Instruct", "7ae557604adf67be50417f59c2c2f167def9a775"),
    ("olmo-2-1b-instruct", 1.0, "OLMo-2-1B", "allenai/OLMo-2-0425-1B-Instruct", "48d788eca847d4d7548f375ad03d3c9312f6139e"),
    ("qwen3.5-1.5b-instruct", 1.5, "Qwen2.5-1.5B", "Qwen/Qwen2.5-1.5B-Instruct", "989aa7980e4cf806f80c7fef2b1adb7bc71aa306"),
    ("smollm2-1.7b-instruct", 1.7, "SmolLM2-1.7B", "HuggingFaceTB/SmolLM2-1.7B-Instruct", "31b70e2e869a7173562077fd711b654946d38674"),
    ("gemma-4-2b-instruct", 2.0, "Gemma-2-2B", "google/gemma-2-2b-it", "299a8560bedf22ed1c72a8a11e7dce4a7f9f51f8"),
    ("granite-3.1-2b-instruct", 2.0, "Granite-3.1-2B", "ibm-granite/granite-3.1-2b-instruct", "bbc2aed595bd38bd770263dc3ab831db9794441d"),
    ("falcon3-3b-instruct", 3.0, "Falcon3-3B", "tiiuae/Falcon3-3B-Instruct", "411bb94318f94f7a5735b77109f456b1e74b42a1"),
    ("phi-4-mini-instruct", 3.8, "Phi-4-mini-3.8B", "microsoft/Phi-4-mini-instruct", "cfbefacb99257ffa30c83adab238a50856ac3083"),
    ("h2o-danube3-4b-chat", 4.0, "H2O-Danube3-4B", "h2oai/h2o-danube3-4b-chat", "1e5c6fa6620f8bf078958069ab4581cd88e0202c"),
    ("yi-1.5-6b-chat", 6.0, "Yi-1.5-6B", "01-ai/Yi-1.5-6B-Chat", "771924d1c83d67527d665913415d7086f11ea9c0"),
    ("qwen3.5-7b-instruct", 7.0, "Qwen2.5-7B", "Qwen/Qwen2.5-7B-Instruct", "a09a35458c702b33eeacc393d103063234e8bc28"),
    ("falcon3-7b-instruct", 7.0, "Falcon3-7B", "tiiuae/Falcon3-7B-Instruct", "1e57a0ecd176c7c139f289c60a74e57f887c3dfb"),
    ("mistral-7b-instruct-v0.3", 7.0, "Mistral-7B-v0.3", "mistralai/Mistral-7B-Instruct-v0.3", "c170c708c41dac9275d15a8fff4eca08d52bab71"),
    ("olmo-2-7b-instruct", 7.0, "OLMo-2-7B", "allenai/OLMo-2-1124-7B-Instruct", "470b1fba1ae01581f270116362ee4aa1b97f4c84"),
]
PARAMETERS = {name: size for name, size, *_ in PANEL}
DISPLAY = {name: shown for name, _, shown, *_ in PANEL}
for _name, _, _, _repo, _revision in PANEL:
    register_model(ModelSpec(_name, _repo, _revision))


def ascending(sizes: list[float]) -> bool:
    """Whether the panel's sizes never fall in display order."""
    return all(a <= b for a, b in zip(sizes, sizes[1:]))


def pick_device(cuda: bool, mps: bool) -> str:
    return "cuda" if cuda else "mps" if mps else "cpu"


def pick_precision(device: str, wanted: str) -> str:
    """CPU runs in single precision, whatever is asked for."""
    return "fp32" if device == "cpu" else wanted
