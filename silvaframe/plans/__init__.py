"""Named SQL plans over the relations of a forest."""
