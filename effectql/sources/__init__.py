"""Sources of card records: binary card databases, JSON dumps and zipped text dumps."""
