"""Plain Python helpers of the brute-force versions."""


def fold(text):
    """Lower-case A-Z only."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
