"""Request metrics and arriving documents, as batch tables or streams."""
