"""Texts written apart from the training sentences and the tables, with their mentions marked: [kind text]; `|` is a new line."""

TEXTS = """Hi team, this is [name Oluwaseun Adebayo] from the night shift.
Please forward to [name Nguyen Thi Hoa] before Tuesday.
My name is [name Björk Guðmundsdóttir] and I own the boat.
Contact [name Xiaoling] if the pump stops.
Sincerely, [name Pradeep Kumar Venkataraman]
My SSN is [id_number 078-05-1120], please remove it from the file.
He gave his SSN, [id_number 123-45-6789], over the phone.
I spoke with [name Fatima al Zahra] about parking and she agreed.
Ticket 48213 was closed by [name Marcin Kowalczyk] without a reply.
Dear [name Mr. Okonkwo], thank you for your letter of 3 March.
Best regards,|[name Ana Lucía Fernández]
Cell: [phone 604-555-0188]. Office: [phone (604) 555-0199].
You can text me on [phone +1 250 555 0143] any time.
Invoices go to [email billing.team@orchard.example] and not to me.
write to [email k_tanaka (at) harbour.example]
I live at [address 1182 Juniper Crescent, Millbrook] and hear the trucks.
Parcel pick-up: [address P.O. Box 77, Fernhurst].
The notice was nailed to the door of [address 45 Old Mill Road].
passport number [id_number GK 482 913] was photocopied twice
Her driver's licence [id_number 5520183] expired in May.
The Harbour Board meets at noon; the Planning Office is closed.
Version 4.12.0.331 of the tool reads 9 tables from Lake Cormorant.
Between 2015 and 2019 the mean was 1,204 mm at Station 12.
Fort Hazel and Mount Edna were not sampled. Neither was Pine Creek.
We asked Larkspur Drilling Ltd. for core 118-2290-441.
Signed, [name Ingeborg Sørensen]
cc [name Tomás de la Cruz], [name Wei Zhang]
Attn: [name Dr. Leila Haddad]
The complaint of [name Mrs. Abernathy-Doyle] is attached.
According to [name Siobhán Ó Briain] the fence was cut.
[name J. R. Whitcombe] called at nine and again at ten.
Ask [name Dmitri] for the keys; his number is [phone 867.555.0121].
On behalf of [name Rosalind Achterberg], I withdraw the request.
The Hazen method and the Thiem equation give different results.
The report by Aspen Ridge Consulting is late, as is Appendix C.
[name Kofi Mensah] wrote twice.
Reply-To: [email zoe.w@lists.pine.example]
We met [name Hiroshi Tanaka] at the gate on Friday.
Order 771-204-8833 is for gravel, not for pipe."""
