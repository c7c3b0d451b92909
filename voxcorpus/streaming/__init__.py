"""The operators over documents as they arrive."""
