"""The settings of a run."""

from __future__ import annotations

from dataclasses import dataclass

LANGS = ("hun", "hun+eng", "eng", "deu", "hun+eng+deu")
SEGMENTATION = ("3", "1", "4", "6", "11", "7")
DPI = (150, 220, 300, 400)
ROTATIONS = (0, 90, 180, 270)


@dataclass(frozen=True)
class Options:
    """Fifteen settings with their defaults; values outside their domain are refused."""

    lang: str = "hun"
    psm: str = "3"
    dpi: int = 220
    rotation: int = 0
    gray: bool = True
    contrast: bool = True
    binarize: bool = False
    upscale: bool = True
    join: bool = True
    hyphen: bool = True
    headings: bool = True
    lists: bool = True
    page_marks: bool = True
    front_matter: bool = False
    pdf_text: bool = True

    def __post_init__(self) -> None:
        for name, domain in (("lang", LANGS), ("psm", SEGMENTATION), ("dpi", DPI), ("rotation", ROTATIONS)):
            if getattr(self, name) not in domain:
                raise ValueError(f"{name} is {getattr(self, name)!r}; it can be one of {domain}")
