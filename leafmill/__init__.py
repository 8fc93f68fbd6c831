"""Document analytics, hierarchical retrieval and corpus preparation on Spark."""

from importlib import import_module

#: What users import from here, by the module that has it; loaded on first use, as workers import this package too.
_HOME = {
    "Config": "config", "DEFAULT": "config",
    "captioner": "functions.models", "embedder": "functions.models", "summariser": "functions.models",
    "chunk_segments": "operators.chunk", "build_tree": "operators.tree",
    "cache_hits": "operators.retrieve", "llm_context": "operators.retrieve", "retrieve": "operators.retrieve", "route": "operators.retrieve",
    "Request": "operators.search", "answer": "operators.search", "search": "operators.search",
    "load_any": "sources.files", "scan": "sources.files", "segments_of": "sources.files",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(f".{_HOME[name]}", __name__), name)
