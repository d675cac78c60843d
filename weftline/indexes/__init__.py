"""Written tables that answer a lookup by reading a part of them."""
