"""How documents are landed."""

import glob
import os

from roamgrid.plans.lineage import shared_folder
from roamgrid.plans.queries import QUERIES
from roamgrid.sources import driver_tables


def test_each_document_is_a_file_without_a_folder_of_its_own(spark, sf_dir):
    QUERIES["osm_json_files"](spark, sf_dir)
    root = shared_folder(spark).removeprefix("file:")
    folder = max(glob.glob(f"{root}/documents-*"), key=os.path.getmtime)
    documents = driver_tables.elements(spark, sf_dir).selectExpr("pos div 1000").distinct().count()
    assert not [x for x in os.listdir(folder) if os.path.isdir(f"{folder}/{x}")]
    assert len(glob.glob(f"{folder}/part-*")) == documents
