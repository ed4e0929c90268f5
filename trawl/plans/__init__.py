"""The filter language and configuration."""
