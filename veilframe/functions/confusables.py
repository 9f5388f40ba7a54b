"""Letters that look like a letter of another script, for the scan's normalizer and for uniform texts."""

from __future__ import annotations

# Letters that look like a letter of another script, by prototype.
LOOK_ALIKE = {
    "a": "аα", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ",
    "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уү", "k": "кκ",
    "A": "АΑᎪꓮⲀ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰⲈ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ", "I": "ІΙӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗⲔ", "L": "Ꮮꓡ", "M": "МΜᎷꓟⲘ",
    "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫⲬ", "Y": "ΥҮꓬⲨ", "Z": "ΖᏃꓜ",
    "μ": "µ", "ß": "ꞵ", "Г": "Γ", "П": "Π", "Ф": "Φ", "ф": "ɸ",
}


def ascii_of() -> dict[str, str]:
    """The letter or digit of ASCII that a letter or digit of another script looks like."""
    digits = {chr(base + i): str(i) for base in (0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xE50) for i in range(10)}
    return {x: k for k, v in LOOK_ALIKE.items() if k.isascii() for x in v} | digits
