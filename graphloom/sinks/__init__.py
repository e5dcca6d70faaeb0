"""Writers: cards, JSON, HTML."""
