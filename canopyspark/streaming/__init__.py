"""Statistics over streams of pixels."""
