"""Schemas and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

BLOCKS = (
    "book_id string, pos long, id string, kind string, text string, links array<string>, anchors array<string>, "
    "note_id string, level int, spans array<array<array<int>>>, page int, asis boolean, drop boolean"
)
KINDS = ("p", "title", "subtitle", "verse", "table", "code", "note", "image", "break")


@dataclass(frozen=True)
class Thresholds:
    """Limits of the operators (fixed values); pass a copy with other values to change one."""

    target_words: int = 2600
    max_words: int = 3600
    max_blocks: int = 70
    verse_group: int = 4
    max_verse: int = 24
    tail_paras: int = 3
    lookahead_words: int = 150
    terms_budget: int = 6000
    terms_tail: int = 1200
    digest_every: int = 8
    code_lines: int = 300
    fix_chars: int = 12000
    fix_max: int = 80
    fix_near: float = 0.65
    ocr_trunc_min: int = 300
    ocr_trunc_ratio: float = 0.6
    window: int = 200
    same: float = 0.8
    title_max: int = 200
    toc_line: int = 260
    skip_max: int = 80
    twin_near: float = 0.85
    twin_len: int = 60
    head_max: int = 120
    head_gap: int = 5
    head_near: float = 0.8
    head_letters: float = 0.5
    col_lines: float = 0.1
    col_pages: float = 0.15
    caption_max: int = 200
    back_tail: float = 0.6
    back_digits: float = 0.95
    back_len: int = 400
    back_min: int = 5
    refs_run: int = 5
    refs_step: int = 8
    refs_hole: int = 40
    refs_tail: int = 2
    note_run: int = 5
    note_gap: int = 3
    min_share: float = 0.025
    loss_low: float = 0.5
    loss_high: float = 2.5
    loss_min: int = 60


T = Thresholds()
