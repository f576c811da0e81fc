"""Landmark-window streaming: hour by hour, state per source, the same profiles as the batch."""
