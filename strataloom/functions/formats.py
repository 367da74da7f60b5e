"""Numbers and credentials as text, for renderers on the driver."""

from __future__ import annotations

import base64


def format_size(n: int) -> str:
    """Bytes in B, KB, MB or GB of 1,024, with one decimal above B."""
    if n < 1024:
        return f"{n} B"
    value, unit = float(n), ""
    for unit in ("KB", "MB", "GB"):
        value /= 1024
        if value < 1024:
            break
    return f"{value:.1f} {unit}"


def thousands(n: int) -> str:
    return f"{n:,}"


def basic_credentials(user: str, token: str) -> str:
    return base64.b64encode(f"{user}:{token}".encode()).decode()
