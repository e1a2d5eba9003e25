"""Where points come from: views of the tables, and files of point clouds."""
