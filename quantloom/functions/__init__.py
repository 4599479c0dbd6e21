"""Part of quantloom."""
