"""Options of chunking and the row type of chunks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields, replace

ENTITY = "struct<name:string,type:string,signature:string,docstring:string,byte_start:int,byte_end:int,line_start:int,line_end:int,is_partial:boolean,parent:string>"
SIBLING = "struct<name:string,type:string,position:string,distance:int,signature:string>"
IMPORT = "struct<name:string,source:string,is_default:boolean,is_namespace:boolean>"
CHUNK_SCHEMA = (
    "doc_id bigint, filepath string, language string, content_type string, index int, total_chunks int, byte_start int, byte_end int, line_start int, line_end int, "
    "token_count int, char_count int, nws_count int, text string, contextualized_text string, section_type string, breadcrumb array<string>, heading_hierarchy array<string>, "
    f"parse_errors array<string>, scope array<{ENTITY}>, entities array<{ENTITY}>, siblings array<{SIBLING}>, imports array<{IMPORT}>, format_metadata map<string,string>, error string"
)


@dataclass(frozen=True)
class Options:
    """What a call of ``chunk`` may set; unknown names are errors."""

    size_unit: str = "tokens"
    max_chunk_size: int = 1500
    min_chunk_size: int = 50
    tokenizer: Callable[[str], int] | str | None = None
    context_mode: str = "full"
    max_siblings: int = 3
    sibling_detail: str = "signatures"
    overlap: float | int = 0
    filter_imports: bool = False
    include_imports: bool = True
    overlap_lines: int = 0
    language: str | None = None
    content_type: str | None = None
    flat_headings: bool = False
    split_oversize: bool = False
    semantic: bool = False
    semantic_embed_fn: Callable[[list[str]], object] | None = None
    semantic_window: int = 3
    semantic_threshold: float = 0.3
    semantic_min_sentences: int = 1
    semantic_sentence_splitter: Callable[[str], list[str]] | None = None

    def __post_init__(self):
        for name, allowed in (("size_unit", ("tokens", "chars", "nws")), ("context_mode", ("none", "minimal", "full")), ("sibling_detail", ("none", "names", "signatures"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {', '.join(allowed)}")
        if self.max_chunk_size <= 0 or self.min_chunk_size < 0:
            raise ValueError("sizes are positive")
        if self.semantic and self.semantic_embed_fn is None:
            raise ValueError("semantic chunks need semantic_embed_fn")
        if self.semantic_window < 1:
            raise ValueError("a window has a sentence at least")

    @classmethod
    def of(cls, base: Options | None = None, **changes) -> Options:
        unknown = set(changes) - {f.name for f in fields(cls)}
        if unknown:
            raise TypeError(f"unknown options: {', '.join(sorted(unknown))}")
        return replace(base or cls(), **changes)
