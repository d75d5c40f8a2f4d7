"""Local decoder models as loaders for ``inference.predict``; the model libraries are imported on workers only."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np

from paravane.registry import ModelSpec, pick_device, pick_precision


def seed_everything(seed: int) -> list[str]:
    """Seed every random source that is installed; their names."""
    random.seed(seed)
    np.random.seed(seed % 2**32)
    seeded = ["random", "numpy"]
    try:
        import torch
    except ImportError:
        return seeded
    torch.manual_seed(seed)
    if torch.cuda.is_available():
        torch.cuda.manual_seed_all(seed)
    return [*seeded, "torch"]


def takes_system(tokenizer: Any) -> bool:
    """Whether the tokenizer's chat template accepts a system message."""
    try:
        tokenizer.apply_chat_template([{"role": "system", "content": "a"}, {"role": "user", "content": "b"}], tokenize=False, add_generation_prompt=True)
    except Exception:  # templates refuse in ways of their own
        return False
    return True


def render_chat(tokenizer: Any, chat: Sequence[dict], system_role: bool, fallback: str | None = None) -> str:
    """The prompt text of a chat: by the tokenizer's template, with the system text put before the user's where that has no such role, or by a fallback with {system} and {user}."""
    said = {m["role"]: m["content"] for m in chat}
    if not tokenizer.chat_template:
        if fallback is None:
            raise ValueError("the tokenizer has no chat template, and no fallback is given")
        return fallback.replace("{system}", "\0").replace("{user}", said.get("user", "")).replace("\0", said.get("system", ""))
    if said.get("system") and not system_role:
        chat = [{"role": "user", "content": f"{said['system']}\n\n{said.get('user', '')}"}]
    return tokenizer.apply_chat_template(list(chat), tokenize=False, add_generation_prompt=True)


def generation(temperature: float = 0.0, max_new_tokens: int = 32, do_sample: bool = False) -> dict:
    """Arguments of a generation; greedy unless sampling is asked for, which alone uses the temperature."""
    return {"max_new_tokens": max_new_tokens, "do_sample": do_sample, **({"temperature": temperature} if do_sample and temperature > 0 else {})}


def decoder(spec: ModelSpec, options: dict, precision: str | None = None, fallback: str | None = None, seed: int = 0) -> Callable[[], Callable[[list], list[str]]]:
    """A loader: called once a worker, it returns a function from a batch of chats to their answers."""

    def load() -> Callable[[list], list[str]]:
        import torch
        from transformers import AutoModelForCausalLM, AutoTokenizer

        seed_everything(seed)
        mps = getattr(torch.backends, "mps", None)
        device = pick_device(torch.cuda.is_available(), bool(mps and mps.is_available()))
        kind = {"fp32": torch.float32, "fp16": torch.float16, "bf16": torch.bfloat16}[pick_precision(device, precision or spec.default_precision)]
        tokenizer = AutoTokenizer.from_pretrained(spec.repo, revision=spec.revision, padding_side="left")
        if tokenizer.pad_token is None:
            tokenizer.pad_token = tokenizer.eos_token
        model = AutoModelForCausalLM.from_pretrained(spec.repo, revision=spec.revision, dtype=kind).to(device).eval()
        system_role = bool(tokenizer.chat_template) and takes_system(tokenizer)

        def answer(chats: list) -> list[str]:
            prompts = [render_chat(tokenizer, [m if isinstance(m, dict) else m.asDict() for m in chat], system_role, fallback) for chat in chats]
            given = tokenizer(prompts, padding=True, return_tensors="pt").to(device)
            with torch.no_grad():
                made = model.generate(**given, **generation(**options), pad_token_id=tokenizer.pad_token_id, eos_token_id=tokenizer.eos_token_id)
            return [text.strip() for text in tokenizer.batch_decode(made[:, given["input_ids"].shape[1] :], skip_special_tokens=True)]

        return answer

    return load
