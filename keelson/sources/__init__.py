"""What is on disk: segments and manifests, and files that records come from or go to."""
