"""Parameters of the two retrieval engines, and the fixed texts they use."""

from __future__ import annotations

from dataclasses import dataclass, field

# Default extension and directory sets of the two scanners.
EXTENSIONS_A = (".yaml", ".yml", ".md", ".txt", ".builder")
IGNORED_A = (".git", "__pycache__", ".venv", "venv", "node_modules", "builder", "dist", "out")
EXTENSIONS_B = (".schema.yaml", ".yml", ".builder", ".md", ".txt")
EXCLUDED_B = (".git", ".rag_cache", "__pycache__", ".venv", "venv", "node_modules", "builder", "dist", "out", ".idea", ".pytest_cache")

# Prompts and answers.
SYSTEM_PROMPT = "Use CONTEXT if it helps. If CONTEXT is irrelevant or weak, answer directly. Be concise and actionable."
GENERAL_PROMPT = "Answer concisely and actionably."
NOT_FOUND = "In indexed files, I cannot find it."
NO_ROOM = "In indexed files, I cannot fit context into the model window."
NO_CONTEXT_A = "No relevant context found in indexed files."
PROMPT_A_HEAD = "Answer using the provided context.\nIf the exact answer is not explicitly stated, provide the closest relevant information from the context.\nBe concise.\n\n"
REWRITE_PROMPT = "You rewrite or translate any user tex into three outputs in this exact order and format:\n[EN]\n...\n[FA]\n...\n[DE]\n...\nNo explanations."


@dataclass(frozen=True)
class Sampling:
    """What a completion asks of the model, beside the prompt; the defaults are those of engine A."""

    max_tokens: int = 256
    temperature: float = 0.2
    top_p: float = 0.95
    repeat_penalty: float = 1.15
    stop: tuple[str, ...] = ("\n\nQuestion:",)


#: Sampling of the rewrite into three languages.
REWRITE_SAMPLING = Sampling(top_p=0.9, repeat_penalty=1.1, stop=())


@dataclass(frozen=True)
class SettingsA:
    """Engine A: crawl, flatten, chunk, vector search over expanded questions."""

    extensions: tuple[str, ...] = EXTENSIONS_A
    ignored: tuple[str, ...] = IGNORED_A
    chunk_size: int = 1000
    chunk_overlap: int = 200
    top_k: int = 8
    max_context_chunks: int = 8
    n_ctx: int = 4096
    max_tokens: int = 256
    sampling: Sampling = field(default_factory=Sampling)


@dataclass(frozen=True)
class Policy:
    """When a question is answered from context, and how sources are shown."""

    vector_min_score: float = 0.22
    keyword_min_score: float = 0.6
    allow_general_fallback: bool = True
    show_sources: bool = True
    max_sources: int = 6


@dataclass(frozen=True)
class SettingsB:
    """Engine B: scan, header, chunk, hybrid search, policy, fitted context."""

    extensions: tuple[str, ...] = EXTENSIONS_B
    excluded: tuple[str, ...] = EXCLUDED_B
    strict_suffix: bool = False
    include_roots: tuple[str, ...] = ()
    max_files: int = 5000
    max_chars_per_file: int = 250_000
    max_chunks_total: int | None = 12_000
    chunk_size: int = 1500
    chunk_overlap: int = 150
    top_k: int = 12
    max_tokens: int = 220
    n_ctx: int = 2048
    embed_n_ctx: int = 2048
    embed_token_margin: int = 64
    sampling: Sampling = field(default_factory=lambda: Sampling(max_tokens=220, stop=()))
    system_prompt: str = SYSTEM_PROMPT
    general_prompt: str = GENERAL_PROMPT
    policy: Policy = field(default_factory=Policy)


def instructions(data: object, nested: bool = False) -> tuple[str, str]:
    """System and general prompt from parsed YAML; anything unusable gives the defaults.

    The sample file nests the keys under ``rag``, where the plain lookup does not see
    them; ``nested`` looks there too.
    """
    top = data if isinstance(data, dict) else {}
    if nested and isinstance(top.get("rag"), dict):
        top = {**top["rag"], **top}

    def text(key: str, default: str) -> str:
        value = top.get(key)
        return value.strip() if isinstance(value, str) and value.strip() else default

    return text("system_prompt", SYSTEM_PROMPT), text("general_system_prompt", GENERAL_PROMPT)


def read_instructions(path: str, nested: bool = False) -> tuple[str, str]:
    """Prompts from a YAML file; an unreadable file gives the defaults."""
    try:
        import yaml

        with open(path, encoding="utf-8", errors="ignore") as f:
            return instructions(yaml.safe_load(f), nested)
    except Exception:  # no parser, no file or malformed text
        return instructions(None)
