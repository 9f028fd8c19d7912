"""Reading dumps and tables, writing results."""
