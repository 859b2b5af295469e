"""Steps of an investigation over many inputs at once: ladders, fan-out and merging."""
