"""Event streams: packets, turn fold, debounce, changed-only sink."""
