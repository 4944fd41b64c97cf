"""General-purpose data preparation: units and moments."""
