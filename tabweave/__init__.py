"""tabweave package."""
